"""The pipeline, each stage judged on its own input; queries against their SQL."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from helpers import DATA, by_id, plain, real, table
from test_llm_decontaminate import brute
from test_llm_models import base
from test_llm_simhash import brute_groups, brute_print


def test_stages(spark):
    sf = f"{DATA}/sf0.001"
    docs, seen = real(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.toArrow())
        seen.append((name, before, docs))
    assert [n for n, _, _ in seen] == ["quality rules", "toxicity", "near copies", "benchmark decontamination", "byte-level BPE"]
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns == real(spark).columns
        assert set(plain(after, "*")) <= set(plain(before, "*"))
    _, before, after = seen[0]
    assert not any(base(t)[-1] for (t,) in by_id(after, "text").values())
    _, before, after = seen[2]
    prints = {i: brute_print(t) for i, (t,) in by_id(before, "text").items()}
    least = brute_groups(sorted(set(prints.values())))
    first = {}
    for i in sorted(prints):
        first.setdefault(least[prints[i]], i)
    assert set(by_id(after, "text")) == set(first.values())
    _, before, after = seen[3]
    items = plain(real(spark, "benchmark"), "item_id", "text")
    assert set(by_id(after, "text")) == {i for i, (t,) in by_id(before, "text").items() if not brute(t, items)[-1]}
    assert set(by_id(seen[4][2], "n_tokens")) == set(by_id(seen[4][1], "text"))


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < 200


def test_empty_and_odd_documents(spark, tmp_path):
    odd = table(spark, [None, "", "one two", "x " * 3000]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, frame in (("odd", odd), ("none", odd.limit(0))):
        sf = str(tmp_path / name)
        frame.write.parquet(f"{sf}/documents.parquet")
        for other in ("labels", "benchmark"):
            real(spark, other).write.parquet(f"{sf}/{other}.parquet")
        assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) & {"op3_benchmark_decontamination", "op9_chat_format"}))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(plain(__spark_entry__.queries()[name](spark, f"{DATA}/sf0.001"), *names), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_columns_of_the_users_own_pass_through(spark):
    """Extra columns, maps among them, with names that the operators could use themselves."""
    docs = real(spark).selectExpr("*", "map('a', 1) AS m", "1 AS _quality", "2 AS _score", "3 AS _match", "4 AS row", "5 AS told", "6 AS key", "7 AS features", "8 AS label", "9 AS id", "10 AS _chosen", "11 AS f")
    sf, got = f"{DATA}/sf0.001", docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, sf)
        assert got.columns == docs.columns
    assert {tuple(r) for r in got.select("_quality", "_score", "_match", "row", "told", "key", "id", "f").distinct().collect()} == {(1, 2, 3, 4, 5, 6, 9, 11)}
