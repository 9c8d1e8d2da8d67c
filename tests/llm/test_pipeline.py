import random

import corpus_pipeline
import numpy as np
import pytest

from tallyroom.llm import decontaminate, neardup

LANGS = {"en": ["the", "ing", "wh", "ou", "er"], "de": ["sch", "ung", "ß", "ein", "ver"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with copies, near copies, leaked items, spread lines and texts without letters."""
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))

    def text(lang, n):
        return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n))

    items = [(i, text("en", 30)) for i in range(6)]
    docs = []
    for i in range(150):
        lang = "en" if i % 3 else "de"
        body = text(lang, rng.randrange(30, 90))
        if i % 10 == 1:
            body += " " + items[i // 10 % 6][1]
        if i % 4 == 0:
            body += "\nThis notice stands on every site of the web"
        docs.append((i, body, lang, f"s{i % 25}", len(body)))
    docs += [(200 + i, docs[i][1], docs[i][2], "s3", docs[i][4]) for i in (3, 5, 9)]
    docs += [(300 + i, docs[i][1] + " ending", docs[i][2], "s4", docs[i][4] + 7) for i in (3, 6, 14)]
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "123 456", "en", "s1", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 7 != 0), int(i % 11 == 0)) for i in range(0, 150, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_name_their_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "mixing"]


def test_each_stage_against_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(columns)] == columns and (name == "mixing" or out.columns == columns)
        before, after = ({r["doc_id"]: r for r in x.collect()} for x in (docs, out))
        gone = set(before) - set(after)
        assert not set(after) - set(before)
        if name == "language_id":
            assert gone == {400, 401, 402}
        elif name == "line_dedup":  # the first document keeps the notice, the others lose it
            notice = [i for i, r in before.items() if "This notice" in r["text"]]
            assert [i for i in notice if "This notice" in after[i]["text"]] == [min(notice)] and not gone
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "minhash_near_dedup":
            groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
            assert gone == {i for i, c in groups.items() if c != i} >= {203, 205, 209, 303}
        elif name == "benchmark_decontamination":
            leaked = {i for i in before if any(r in before[i]["text"] for r in kept["items"])}
            assert leaked and gone == leaked
        kept[name] = set(after)
        kept["items"] = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
        out.write.parquet(f"{folder}/{name}.out")
        docs = spark.read.parquet(f"{folder}/{name}.out")
    run = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert run <= kept["benchmark_decontamination"] and len(run ^ kept["mixing"]) <= 2


def test_decontamination_stage_learns_from_every_passage_of_its_input(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    maps, fit = [], decontaminate.latent_map

    def kept(*tables):
        maps.append(fit(*tables))
        return maps[-1]

    monkeypatch.setattr(decontaminate, "latent_map", kept)
    gone = set()
    for size in (20_000, 10):  # a bound on passages that must not be heeded
        monkeypatch.setattr(decontaminate, "SAMPLE_PASSAGES", size, raising=False)
        gone.add(frozenset(r["doc_id"] for r in docs.join(corpus_pipeline.drop_contaminated(spark, docs, folder), "doc_id", "left_anti").collect()))
    (a, _), (b, _) = maps
    assert len(gone) == 1 and a.shape == b.shape and np.abs(a @ a[:50].T - b @ b[:50].T).max() < 1e-3 * np.abs(a @ a[:50].T).max()


def test_map_of_the_decontamination_stage_is_that_of_dense_products_over_all_its_input(spark, tmp_path, monkeypatch):
    from test_decontaminate import _few_words, _plain_map

    monkeypatch.setattr(decontaminate, "SAMPLE_PASSAGES", 50, raising=False)  # a bound that must not be heeded
    texts, items = _few_words(11)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    maps, fit = [], decontaminate.latent_map
    monkeypatch.setattr(decontaminate, "latent_map", lambda *tables: maps.append(fit(*tables)) or maps[-1])
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string").repartition(3)
    corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count()
    want, some, _ = _plain_map(texts, items)
    ((latent, _),) = maps
    want, got = want[some] @ want[some].T, latent[some] @ latent[some].T
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()
