import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidelog.llm import decontaminate, quality, queries, secrets

SF = "/root/testdata/sf0.001"


def similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (brute.words_of(t.translate(brute.LOWER)) for t in (a, b)))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{n}")
        columns = docs.columns
        docs = spark.read.parquet(f"{root}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        out.append(docs.collect())
    return [spark.read.parquet(f"{SF}/documents.parquet").collect(), *out]


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_keeps_what_passes(stages, spark):
    before, after = by_id(stages[0]), by_id(stages[1])
    for i, text in before.items():
        n, chars, symbols, dups, repeats, failed = brute.quality(text)
        lines = sum(bool(brute.words_of(x)) for x in text.split("\n"))
        bad = failed or symbols > 0.05 * chars or dups > 0.5 * lines or not 2 <= chars / n <= 18 or len(set(brute.words_of(text)) & set(quality.STOP_WORDS)) < 2
        assert (i in after) == (not bad)
        assert i not in after or after[i] == text


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    ids = sorted(after)
    for n, a in enumerate(ids):
        assert all(similarity(after[a], after[b]) < 0.85 for b in ids[:n])
    for i in before.keys() - after.keys():
        assert max(similarity(before[i], before[j]) for j in before if j != i) >= 0.7


def test_contaminated_documents_go(stages, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute.decontaminate([(r["doc_id"], r["text"]) for r in stages[2]], items) if r[-1]}
    assert hit and by_id(stages[2]).keys() - by_id(stages[3]).keys() == hit


def test_secrets_are_replaced(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (after[i] == text) == (not brute.secrets(text))
        assert not [x for x in brute.secrets(after[i]) if not x.startswith("assign")]


def test_all_that_stays_is_packed(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for i, text in by_id(stages[4]).items():
        x = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected |= {(i, at // 2048, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes())) for at in range(0, len(x), 2048)}
    assert {tuple(r)[:5] for r in stages[5]} == expected


def test_run_gives_the_last_stage(stages, spark):
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in stages[5])


def test_stages_take_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"the w{k} of" for k in range(60))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, text + " more", None, None, None)]
    for data in (rows, []):
        df = spark.createDataFrame(data, kinds)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).collect()
    one = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, kinds), SF).collect()
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "2"]
    assert decontaminate.drop_contaminated(spark.createDataFrame(rows, kinds), spark.createDataFrame([], "item_id long, text string")).count() == 5
    assert secrets.redact(spark.createDataFrame(rows, kinds)).count() == 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(expected, key=str)


def test_simhash_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op8_simhash(spark, SF).collect()), key=str) == brute.simhash_groups(docs)
