"""quarry: document retrieval and question-answering analytics as Spark jobs.

Every operator takes DataFrames plus parameters and returns a DataFrame.
Work is expressed with DataFrame/SQL built-ins so Catalyst can push
filters, prune columns and plan the shuffles; Arrow-batched pandas code
appears only where no built-in can express the semantics (recursive
chunking, DOCX unzip, dense top-k inside a bounded block).
"""

from quarry.session import build_session, load_table, shared_dir

__all__ = ["build_session", "load_table", "shared_dir"]
