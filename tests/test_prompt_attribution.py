from quarry.operators import attribution as G
from quarry.operators import prompt, retrieve


CASES = [
    (1, "alpha beta", "<1>: alpha\n\n<2>: beta <3>: gamma\n\n<10>: kappa\n\n<11>: lambda"),
    (2, "", "<1>: x"),
    (3, "ab", "<1>: ba\n\n<2>: ab"),
    (4, "zzz", "<1>: abc\n\n<2>: def"),
]

# worked out by hand: the piece most like the answer shows the answer's characters as "same"
SPANS = {
    1: [("<1> alpha\n\n<2>", "other"), (" beta ", "same"), ("<3> gamma\n\n<4> kappa\n\n<5> lambda", "other")],
    2: [("<1> x", "other")],
    3: [("<1> ba\n\n<2> ", "other"), ("ab", "same")],
    4: [("<1> abc\n\n<2> def", "other")],
}


def test_highlight_spans_by_hand(spark):
    df = spark.createDataFrame(CASES, "qa_id long, answer string, contexts string")
    spans = G.highlight_spans(df, "qa_id").collect()
    for qa_id, answer, ctx in CASES:
        got = [(r.text, r.label) for r in sorted((r for r in spans if r.qa_id == qa_id), key=lambda r: r.span_no)]
        assert got == SPANS[qa_id], qa_id
        assert all(x[1] != y[1] for x, y in zip(got, got[1:]))


def test_hybrid_dedup_keeps_first(spark):
    vec = spark.createDataFrame([(1, "a", "s", 1), (1, "b", "s", 2)], "item_id long, content string, source string, rank long")
    lex = spark.createDataFrame([(1, "b", "s", 1), (1, "c", "s", 2), (1, "a", "t", 3)],
                                "item_id long, content string, source string, rank long")
    got = [(r.content, r.source, r.leg, r.pos) for r in
           retrieve.hybrid_context(vec, lex).orderBy("pos").collect()]
    assert got == [("a", "s", 0, 1), ("b", "s", 0, 2), ("c", "s", 1, 3), ("a", "t", 1, 4)]


def test_rerank_zero_one_tied(spark):
    q = spark.createDataFrame([(1, "red apple"), (2, "blue"), (3, "green")], "item_id long, text string")
    ctx = spark.createDataFrame([(1, "apple red", 2), (1, "red apple pie", 1), (1, "pear", 3), (2, "blue sky", 1)],
                                "item_id long, content string, pos long")
    got = retrieve.rerank(q, ctx, keep=3).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.content) for r in got] == [(1, "red apple pie"), (1, "apple red"), (1, "pear"),
                                                     (2, "blue sky")]


def test_prompt_format(spark):
    q = spark.createDataFrame([(1, "Q?"), (2, "none")], "item_id long, text string")
    rr = spark.createDataFrame([(1, 2, "second", "s2"), (1, 1, "first", "s1")],
                               "item_id long, rank long, content string, source string")
    rows = {r.item_id: r for r in prompt.build_prompt(rr, q).collect()}
    assert rows[1].prompt == "<文本片段>:\n\n1: first\n2: second\n\n<问题>: Q?\n<回答>: "
    assert rows[1].contexts == "<1>: first\n\n<2>: second"
    assert rows[1].sources == "<1>: s1\n\n<2>: s2"
    assert rows[2].n_contexts == 0 and rows[2].contexts == ""


def test_contexts_are_dealt_by_question_once(spark):
    """Dedup, rerank and the prompt's grouping need no shuffle of the texts but one."""
    from quarry.operators import retrieve
    lex = spark.createDataFrame([(q, f"text {c % 3}", "s", c) for q in range(5) for c in range(1, 6)], "item_id long, content string, source string, rank long")
    q = spark.createDataFrame([(i, "text 1") for i in range(5)], "item_id long, text string")
    ctx = retrieve.hybrid_context(lex.limit(0), lex)
    top = retrieve.rerank(q, ctx, keep=2)
    plan = top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(item_id" in x]
    assert len(dealt) <= 2 and sum("REPARTITION_BY_NUM" in x for x in dealt) == 1  # the contexts, and the questions unless broadcast
    got = {(r.item_id, r.content, r.rank) for r in top.collect()}
    assert got == {(i, "text 1", 1) for i in range(5)} | {(i, "text 2", 2) for i in range(5)}
