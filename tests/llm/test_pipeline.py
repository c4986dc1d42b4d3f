import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as contract
from compare import database, difference
from tillsight.llm import bpe, decontaminate, lines, queries, simhash
from tillsight.plans.shared import stored

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Every stage against what its operator's plain counterpart says of the stage's own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, DATA), "stage")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and after.keys() <= before.keys()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = (before, after)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = seen["quality"]
    judged = [i for i in before if i in labels]
    assert sum((i in after) == bool(labels[i]) for i in judged) >= 0.97 * len(judged)
    assert all(after[i] == before[i] for i in after)

    before, after = seen["line_dedup"]
    assert after.keys() == before.keys() and all(r["n_chars"] == len(r["text"]) for r in after.values())
    frame = spark.createDataFrame(list(before.values()))
    with duckdb.connect() as connection:
        documents = frame.toPandas()  # noqa: F841  read by the SQL below
        wanted = dict(connection.execute(f"select doc_id, text from ({lines.OP2_SQL})").fetchall())
    assert {i: r["text"] for i, r in after.items()} == wanted

    before, after = seen["near_dedup"]
    prints = {i: simhash.fingerprint(r["text"].encode()) for i, r in before.items()}
    ids = sorted(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if least[j] < least[i] and bin(prints[i] ^ prints[j]).count("1") <= 3:
                    least[i], changed = least[j], True
    assert after.keys() == {i for i in ids if least[i] == i}

    before, after = seen["decontamination"]
    items = [(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in decontaminate.windows_of(decontaminate.words_of(t), 13)}
    for i, r in before.items():
        words = decontaminate.words_of(r["text"].encode())
        hit = {k for w in windows for s in range(len(words)) if tuple(words[s : s + len(w)]) == w for k in range(s, s + len(w))} if windows & {
            tuple(words[s : s + 13]) for s in range(len(words))
        } else set()
        assert (i in after) == (not hit or 20 * len(hit) < len(words))

    before, after = seen["bpe"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_file())
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert r["ids"] == library.encode(before[i]["text"], add_special_tokens=False).ids


def test_stages_take_the_odd_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, DATA), "stage")
        assert set(docs.columns) >= {"doc_id", "ids", "n_tokens"}


def test_run_is_all_stages(spark):
    found = contract.queries()["pipeline"](spark, DATA)
    assert found.count() > 0 and "pipeline" not in contract.oracle_sql()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, name):
    with database(DATA) as connection:
        assert difference(queries.QUERIES[name](spark, DATA), connection, queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14)) and queries.QUERIES.keys() <= contract.queries().keys()
