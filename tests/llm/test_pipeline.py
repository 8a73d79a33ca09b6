"""The corpus pipeline on a small corpus with planted cases, stage by stage and as a whole."""

import numpy as np
import pytest

import corpus_pipeline


def prose(seed: int, n: int = 12) -> str:
    rng = np.random.default_rng(seed)
    syllables = ["ka", "ro", "min", "tel", "sa", "vor", "un", "li", "der", "po"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(2, 5))))
    small = ["the", "of", "and", "in", "that", "is", "with", "by"]
    return " ".join(" ".join([word().capitalize(), *(word() if rng.random() < 0.7 else str(rng.choice(small)) for _ in range(8))]) + "." for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    item = "a question about the wide world of numbers and letters that nobody has answered before in this small town by the sea"
    rows = [(k, prose(k)) for k in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " Indeed."), (102, prose(200) + " " + item + " " + prose(201)), (103, prose(202) + " Write to some.one@mail.example.com soon."), (104, "buy now " * 100), (105, None), (106, "")]
    docs = [(i, t, "en", "s", len(t) if t is not None else 0) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").cache()
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, tables).cache()
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert ids["quality rules"] == {*range(60), 100, 101, 102, 103}
    assert ids["n-gram Jaccard join"] == {*range(60), 102, 103}
    assert ids["benchmark decontamination"] == ids["PII"] == {*range(60), 103}
    red = next(r for r in seen["PII"] if r.doc_id == 103)
    assert "<email>" in red.text and "example" not in red.text and red.n_chars == len(red.text)
    assert ids["best-fit packing"] == ids["PII"]
    assert corpus_pipeline.run(spark, tables).count() == len(seen["best-fit packing"])


def test_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("false")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, tables)
        assert docs.count() == 0


def test_rows_that_share_an_id(spark, tables):
    """Missing and repeated ids, long texts and clashing columns: each row has its own verdict."""
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    bad, dirty, long = "buy now " * 100, f"{prose(302)} {item} {prose(303)}", prose(304, 3_000)
    rows = [(None, prose(300)), (None, bad), (None, dirty), (7, prose(301)), (7, bad), (7, dirty), (7, prose(301)), (8, prose(301) + " Indeed."), (9, long), (None, long + " x")]
    docs = spark.createDataFrame([(*r, k, k, k) for k, r in enumerate(rows)], "doc_id long, text string, row_id long, row_text long, n_chars long")
    for (_, f), want in zip(corpus_pipeline.STAGES[:4], [{0, 2, 3, 5, 6, 7, 8, 9}, {0, 2, 3, 9}, {0, 3, 9}, {0, 3, 9}], strict=True):
        docs = f(spark, docs, tables).cache()
        # Of rows equal in id and text, either may stay.
        got = {r.row_id for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "row_id", "row_text", "n_chars"] and (got if 3 in got else got - {6} | {3}) == want


def test_workers_let_go_of_the_encoder_before_other_stages(spark):
    import public_tokenizers

    from driftloom.llm import _tokens
    from driftloom.llm.jaccard import _signatures
    from driftloom.llm.pii import redact
    from driftloom.llm.quality import keep_good

    path = str(public_tokenizers.path("byte_bpe_50k.json"))

    def held(stage):
        """Encoders that are left when a worker which had one has run the stage's function."""
        import pickle

        from pyspark import cloudpickle

        found = []
        frame = type("Frame", (), {"columns": ["text"], "schema": spark.createDataFrame([], "text string").schema, "sparkSession": spark})()

        class Run(Exception):
            pass

        def take(f, *_):
            found.append(pickle.loads(cloudpickle.dumps(f)))
            raise Run

        frame.mapInArrow = take
        frame.select = lambda *_: frame
        with pytest.raises(Run):
            stage(frame)
        _tokens.encoder(path)
        list(found[0](iter([])))
        return len(_tokens._ENCODERS)

    assert held(keep_good) == 0
    assert held(lambda f: _signatures(f, 5, 80)) == 0
    assert held(lambda f: redact(f, model={})) == 0
