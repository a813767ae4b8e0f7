"""Each stage of the pipeline against a plain version of it, on a small corpus with planted cases."""

import random
import re

import corpus_pipeline
from test_near_copies import plain_components
from test_texts import plain_secrets

WINDOW = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def plain_words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(900)]

    def prose(words):
        out = []
        while len(out) < words:
            line = rng.choices(vocabulary, k=rng.randint(5, 12))
            out += [line[0].capitalize(), *line[1:-1], line[-1] + "."]
        return out

    items = [(k, " ".join(prose(14))) for k in range(6)] + [(7, " ".join(prose(5)[:4])), (8, None)]
    docs, junk, doc = [], set(), 0
    for _ in range(260):
        base = prose(rng.choice([12, 60, 200]))
        if rng.random() < 0.1:
            base[8:8] = [SECRET]
        if rng.random() < 0.1:
            base[5:5] = items[rng.randrange(6)][1].upper().split()
        docs.append((doc, " ".join(base)))
        doc += 1
        if rng.random() < 0.2:
            changed = list(base)
            changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            docs.append((doc, " ".join(changed)))
            doc += 1
        if rng.random() < 0.25:
            kind = rng.randrange(3)
            words = [w.strip(".") for w in prose(60)]
            bad = [[f"{w} |" for w in words], [f"{w.upper()}!!" for w in words], [f"{w}{rng.choice('$%&*') * 3}" for w in words]][kind]
            docs.append((doc, " ".join(bad)))
            junk.add(doc)
            doc += 1
    docs += [(doc, None), (doc + 1, "")]
    return docs, items, junk


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, items, junk = corpus()
    folder = str(tmp_path)
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    inputs = [dict(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, frame, folder).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == columns
        inputs.append({r["doc_id"]: r["text"] for r in frame.collect()})
        assert frame.count() == len(inputs[-1])

    texts, kept, alone, clean, masked = inputs
    assert set(texts) - set(kept) == junk

    least = {doc: component for doc, _, component in plain_components(sorted(kept.items()))}
    assert set(alone) == {doc for doc in kept if least[doc] == doc} and len(alone) < len(kept)

    windows = set()
    for _, item in items:
        words = plain_words(item)
        size = min(WINDOW, len(words))
        windows |= {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()
    sizes = {len(w) for w in windows}

    def dirty(text):
        words = plain_words(text)
        return any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))

    assert set(clean) == {doc for doc, text in alone.items() if not dirty(text)} and len(clean) < len(alone)

    assert set(masked) == set(clean)
    for doc, text in clean.items():
        if plain_secrets(text or ""):
            assert SECRET[:20] in text and SECRET[:20] not in masked[doc] and "<SECRET>" in masked[doc]
        else:
            assert masked[doc] == text

    packed = corpus_pipeline.STAGES[-1][1](spark, frame, folder).toPandas()
    assert set(packed.doc_id) == set(masked)
    whole = corpus_pipeline.run(spark, folder).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[names].values.tolist())) == sorted(map(tuple, packed[names].values.tolist()))


def test_stages_work_on_rows_and_not_on_ids(spark, tmp_path):
    one, two, three = ([f"{name}{k}" for k in range(30)] for name in "abc")
    a, b, c, near = " ".join(one), " ".join(two), " ".join(three), " ".join(["other", *one[1:]])
    item = " ".join(f"bench{k}" for k in range(12))
    rows = [(5, a), (8, near), (3, b), (5, b), (5, b)]  # one id over a root and over a copy
    rows += [(7, f"{k} " + " ".join(f"{k}x{n}" for n in range(9))) for k in range(4)]  # one id, different texts
    rows += [(None, c), (None, c), (None, a), (None, "alone here"), (None, None), (None, None), (9, ""), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.ngram_jaccard_join(spark, read, str(tmp_path))
    wanted = [(5, a), (3, b), *rows[5:9], (None, c), *rows[12:]]
    assert kept.columns == read.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, wanted))

    rows = [(1, f"x {item}"), (1, "clean"), (None, f"{item} y"), (None, "clean"), (None, None), (2, f"x {item}"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[6]]))


def test_columns_of_the_user_come_back_unchanged(spark, tmp_path):
    docs, items, _ = corpus()
    names = ["pattern", "junk_posterior", "clean_score", "row", "_row", "row1", "_text", "text_key", "Column 0", "id", "n", "node", "part"]
    rows = [(d, t, *[f"{name} of {d}" for name in names]) for d, t in docs[:60]]
    schema = "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in names)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frame, str(tmp_path))
        assert kept.columns == frame.columns, name
        found = kept.collect()
        assert len(found) > 20
        for r in found:
            assert list(r)[2:] == [f"{n} of {r['doc_id']}" for n in names], name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() >= 60


def test_stages_on_very_long_and_on_no_texts(spark, tmp_path):
    texts = [" " * 2_000_000, "\n" * 1_000_000, "a" * 1_000_000, "5 " * 300_000, "word " * 200_000, None, ""]
    spark.createDataFrame([(1, "x " * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {0, 1, 5, 6} <= set(found.doc_id) and (found.length <= 2048).all()
