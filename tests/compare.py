"""Run registered queries beside their SQL twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


#: Queries without SQL, and why. A query that is not listed needs a twin; a listed one must give rows.
NO_TWIN = {
    **dict.fromkeys(["fuzzy_ratio", "snippet"], "sequence matching has no SQL form; brute force in test_operators"),
    **dict.fromkeys(["html_text", "image_refs"], "HTML is parsed; cases in test_functions"),
    "ivf_knn_probed": "approximate; recall in test_vectorlists",
    **dict.fromkeys(
        ["two_level_select", "evaluate", "tournament_rerank", "lexical_rerank", "normalize_query", "enrich_documents", "embed_terms", "sync_job", "build_catalogue", "document_assembly"],
        "composed of operators that have twins",
    ),
    "sample_documents": "a sample by Spark's hash", "request_lease_stream": "a state machine; its model in test_stateful_streams",
    **{name: "see tests/llm" for name in ("op2_quality_rules", "op4_toxicity", "op6_packing", "op8_secrets", "op9_byte_bpe", "op10_sharding", "pipeline")},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "0") if v == int(v) else f"{v:.6f}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """(ok, message) of one query."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if not sql:
        reason = NO_TWIN.get(name)
        return bool(reason and got), f"{len(got)} rows, no twin: {reason}"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a == b:
        return True, f"{len(a)} rows"
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return False, f"{len(a)} vs {len(b)} rows\n   spark {str(only_a)[:900]}\n   duck  {str(only_b)[:900]}"


def main(argv):
    from pyspark.sql import SparkSession

    sf_dir = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tarnwell import registry

    registry.load()
    con = connect(sf_dir)
    bad = []
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name == w or (w.startswith("@") and fn_module(fn) == w[1:]) for w in wanted):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, registry.TWINS.get(name))
        except Exception as exc:
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "FAIL", name, msg, f"{time.time() - t:.1f}s", flush=True)
    print("failed:", bad)


def fn_module(fn):
    return fn.__closure__[0].cell_contents.__module__.rsplit(".", 1)[-1]


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1:])
