"""Fixed values that must equal the original application's for equal results.

They are listed plainly, in their natural order, and are not derived.
"""

# --- fixed values: English stop words shipped with the lexical analyser (33) ---
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
]

# --- fixed values: word lists shipped with the lexical analyser (the longer ones, of quantifiers and
# single characters, are read from files of the same form) ---
PREPOSITIONS = "不 也 了 仍 从 以 使 则 却 又 及 对 就 并 很 或 把 是 的 着 给 而 被 让 但".split()
SUFFIXES = ("乡 井 亭 党 区 厅 县 园 塔 家 寺 局 巷 市 弄 所 斯基 楼 江 河 海 湖 省 维奇 署 苑 街 觀 观 诺夫 路 部 镇 "
            "阁 山 子 娃").split()
SURNAMES = ("丁 万 万俟 上官 东方 乔 于 令狐 仲孙 任 何 余 候 傅 公冶 公孙 公羊 冯 刘 单 单于 卢 史 叶 司徒 司空 司马 吕 吴 周 唐 夏 "
            "夏侯 太叔 姚 姜 孔 孙 孟 宇文 宋 宗政 尉迟 尹 崔 常 康 廖 张 彭 徐 慕容 戴 文 方 易 曹 曾 朱 李 杜 杨 林 梁 欧阳 武 段 毛 江 汤 "
            "沈 淳于 潘 澹台 濮阳 熊 王 田 申屠 白 皇甫 石 秦 程 罗 肖 胡 苏 范 董 蒋 薛 袁 许 诸葛 谢 谭 贺 贾 赖 赫连 赵 轩辕 邓 邱 邵 "
            "邹 郑 郝 郭 金 钟 钟离 钱 长孙 闻人 闾丘 阎 陆 陈 雷 韩 顾 马 高 魏 鲜于 黄 黎 龙 龚").split()
EXTRA_STOP_WORDS = ("也 了 仍 从 以 使 则 却 又 及 对 就 并 很 或 把 是 的 着 给 而 被 让 在 还 比 等 当 与 于 但 的 地 得 是 什么 多少 "
                    "那么 这样 这个 那个 这么").split()
USER_WORDS = "林西强 戚发轫 芯片".split()

# --- fixed values: upload extension allow-list (last suffix, case-sensitive) ---
ALLOWED_EXTENSIONS = ["txt", "pdf", "docx"]

# --- fixed values: numbered QA prompt (prefix, item format, suffix) ---
PROMPT_PREFIX = "<文本片段>:\n\n"
PROMPT_QUESTION_LABEL = "\n<问题>: "
PROMPT_ANSWER_LABEL = "\n<回答>: "
# prompt item:   "{i}: {text}\n"       (i counts from 1)
# context item:  "<{i}>: {text}"       joined by "\n\n"
# source item:   "<{i}>: {source}"     joined by "\n\n"
CONTEXT_JOINER = "\n\n"

# --- fixed values: query/key instructions per retrieval task ---
TASK_INSTRUCTIONS = [
    ("qa", "query", "Represent this query for retrieving relevant documents: "),
    ("qa", "key", "Represent this document for retrieval: "),
    ("convsearch", "query", "Encode this query and context for searching relevant passages: "),
    ("convsearch", "key", "Encode this passage for retrieval: "),
    ("chat", "query", "Embed this dialogue to find useful historical dialogues: "),
    ("chat", "key", "Embed this historical dialogue for retrieval: "),
    ("lrlm", "query", "Embed this text chunk for finding useful historical chunks: "),
    ("lrlm", "key", "Embed this historical text chunk for retrieval: "),
    ("icl", "query", "Convert this example into vector to look for useful examples: "),
    ("icl", "key", "Convert this example into vector for retrieval: "),
    ("tool", "query", "Transform this user request for fetching helpful tool descriptions: "),
    ("tool", "key", "Transform this tool description for retrieval: "),
]

# --- fixed values: query instruction of the retrieval encoder ---
QUERY_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："

# --- fixed values: highlight labels and dialogue speakers ---
LABEL_SAME = "same"
LABEL_OTHER = "other"
USER_SPEAKER = "User: "
MODEL_SPEAKER_FMT = "Model ({model}): "

# --- fixed values: record cleaning literal ---
EMPTY_INTRO_LITERAL = "简介:nan"

# --- fixed values: workload defaults ---
CHUNK_SIZE = 250
CHUNK_OVERLAP = 0
VECTOR_TOPK = 10
VECTOR_THRESHOLD = 0.5
LEXICAL_TOPK = 10
LEXICAL_TOPK_EVAL = 30
RERANK_KEEP = 3
NLIST = 128
NPROBE = 10
SOURCE_MAX = 100
TEXT_MAX = 1000
VECTOR_DIM = 1024
EMBED_DIM = 256  # width of the encoder stand-in; own choice
CHUNKS_PER_DOC = 1 << 20  # own choice, for chunk keys
EMBED_TITLE_OVER = 128
SAMPLE_CAP = 3000
EVAL_PER_SOURCE = 100
COMPRESS_OVER = 500
PROGRESS_EVERY = 50
RETENTION_DAYS = 90
TABLE_BOTTOM_GAP = 100
MAX_TOKENS = 300

# --- fixed values: chat payload ---
# (the configured text ends with a backslash and an "n", not a newline)
SYSTEM_ROLE = "你是一个出色的文档问答助手，根据给定的文本片段和问题进行回答，回答要合理、简洁，回复语言采用中文。\\n"
DEFAULT_MODELS = ["glm-4"]
GLM_TEMPERATURE = 0.8
OTHER_TEMPERATURE = 0.0
