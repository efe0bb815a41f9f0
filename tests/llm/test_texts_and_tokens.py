import random

import duckdb
import pytest

import corpus_pipeline
from lectern.llm import bpe, decontamination, substrings
from lectern.llm.oracles import ORACLES
from lectern.llm.queries import QUERIES, public_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())
    assert got == sorted(answer.fetchall())


def test_chunks_agree_with_the_library():
    files = public_tokenizer()
    small = bpe.ChunkEncoder(**files, bits=4)
    parts = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "'s", "1", "é", "日本", " the", ".", " ", "😀", "\t", "<|"]
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        whole = small.library.encode(text, add_special_tokens=False).ids
        ids = small.encode(text.encode())
        assert ids.tolist() == whole
        assert small.decode(ids).decode() == small.library.decode(whole, skip_special_tokens=False)


def test_encoding_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "word " * 30_000), (2, "<|endoftext|> x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = bpe.encode(docs, **public_tokenizer())
    assert sorted((r["n_tokens"] == 0, r["decoded"]) for r in got.collect()) == sorted((not t, t or "") for _, t in rows)
    assert {r["decoded"] for r in bpe.decode(got, **public_tokenizer()).collect()} == {t or "" for _, t in rows}
    assert bpe.encode(docs.limit(0), **public_tokenizer()).count() == 0


def test_repeats_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(30))
    rows = [(5, run), (3, "x " + run + " y"), (4, run + " " + run), (6, None), (None, run), (7, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS spans")
    got = {r["doc_id"]: r["kept"] for r in substrings.cut_repeats(docs).collect()}
    assert got == {3: "x " + run + " y", 4: "", 5: "", 6: "", None: run, 7: "w1 w2"}
    assert substrings.cut_repeats(docs.limit(0)).count() == 0


def test_matches_odd_rows(spark):
    phrase = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame(
        [(1, "a " + phrase + " b"), (1, phrase.upper()), (2, None), (3, " ".join(reversed(phrase.split()))), (None, "short one")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, phrase), (8, "SHORT, one!"), (9, None), (10, ""), (None, "a")], "item_id long, text string")
    got = decontamination.decontaminate(docs, items).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"], r["n_near"]) for r in got)
    assert found == [("1", 13, 13, ["7"], 0), ("1", 15, 13, ["7"], 0), ("2", 0, 0, [], 0), ("3", 13, 0, [], 1), ("None", 2, 2, ["8"], 0)]
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0


def near_items(docs, items, near_terms):
    """Items that each document holds a near stretch of, by looking at every stretch."""
    split = [(d, decontamination.words_of(t.encode())) for d, t in docs]
    df = {}
    for _, words in split:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    found = {}
    for item, text in items:
        words = decontamination.words_of(text.encode())
        rarest = sorted((w for w in set(words) if w in df), key=lambda w: (df[w], w))[:near_terms]
        needed = len(rarest) - (len(rarest) > 2)
        for d, own in split:
            stretches = (own[i : i + len(words)] for i in range(len(own)))
            if len(rarest) > 1 and any(len(set(rarest) & set(s)) >= needed for s in stretches):
                found.setdefault(d, set()).add(item)
    return found


@pytest.mark.parametrize(("partitions", "shard_bytes"), [(1, 2 << 20), (3, 10_000), (8, 400)])
def test_proximity_does_not_depend_on_shards(spark, partitions, shard_bytes):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 6, 14, 20])))) for i in range(30)]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 60])))) for d in range(300)]
    for d, (_, text) in enumerate(items):  # each item once more with a word replaced, others shuffled
        words = text.split()
        words[rng.randrange(len(words))] = "else"
        docs.append((1000 + d, " ".join(rng.choices(vocabulary, k=9) + words + ["end"])))
        docs.append((2000 + d, " ".join(rng.sample(words, len(words)))))
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(given, shard_bytes=shard_bytes)
    matches = decontamination.search(index, asked).collect()
    got = {}
    for m in matches:
        if m["kind"] == "near":
            got.setdefault(m["doc_id"], set()).add(m["item_id"])
    assert got == near_items(docs, items, decontamination.NEAR_TERMS)
    judged = decontamination.decontaminate(given, asked, shard_bytes=shard_bytes).collect()
    exact = {(m["doc_id"], m["item_id"]) for m in matches if m["kind"] == "exact"}
    assert all(r["n_near"] == len({i for i in got.get(r["doc_id"], ()) if (r["doc_id"], i) not in exact}) for r in judged)
    assert sum(len(v) for d, v in got.items() if d >= 1000) > 30


def test_an_unrelated_document_does_not_make_a_match(spark):
    item = " ".join(f"i{k}" for k in range(14))
    changed = item.replace("i5", "other")
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    for others in ([], [(2, "i5 alone")], [(3, "i5 " + "x " * 50)]):
        docs = spark.createDataFrame([(1, changed), *others], "doc_id long, text string").coalesce(1)
        judged = {r["doc_id"]: (r["n_near"], r["contaminated"]) for r in decontamination.decontaminate(docs, asked).collect()}
        assert judged[1] == (1, False) and all(v == (0, False) for d, v in judged.items() if d != 1)


def test_pipeline_keeps_rows_by_their_own_text(spark):
    """Two texts under one id and under none: nothing goes that is not rejected for its own text."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    english = [r["text"] for r in base.where("lang = 'en' AND n_chars > 800").orderBy("doc_id").limit(6).collect()]
    made = [" ".join(f"{a} {b}" for a, b in zip(english[k].split()[:90], english[k + 1].split()[:90], strict=False)) for k in range(4)]
    phrase = base.sparkSession.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    junk = "".join(chr(0x4E00 + (k * 7919) % 5000) for k in range(400))
    odd = [(900_001, made[0]), (900_001, made[1]), (None, made[2]), (None, made[3]), (900_001, phrase), (None, phrase), (900_001, junk)]
    rows = spark.createDataFrame(odd, "doc_id long, text string").selectExpr(
        *[c if c in ("doc_id", "text") else f"CAST(NULL AS {t}) AS {c}" for c, t in ((f.name, f.dataType.simpleString()) for f in base.schema.fields)]
    )
    docs = base.unionByName(rows)

    def left(df):
        return sorted((r["doc_id"] or 0, r["text"]) for r in df.where("doc_id IS NULL OR doc_id > 900000").collect())

    clean = sorted((d or 0, t) for d, t in odd if t in made)
    assert [x for x in left(corpus_pipeline.known_language(spark, docs, SF)) if x[1] in made] == clean
    assert left(corpus_pipeline.uncontaminated(spark, docs, SF)) == sorted([*clean, (900_001, junk)])
    near = left(corpus_pipeline.one_of_near_copies(spark, docs, SF))
    assert near == sorted([*clean, (900_001, junk), (900_001, phrase)]) or near == sorted([*clean, (900_001, junk)])
    twice = rows.where("text LIKE '% %'").unionByName(base.limit(3)).selectExpr("*", "concat(text, '\nonce\nonce') AS t").drop("text")
    cut = corpus_pipeline.without_repeated_lines(spark, twice.withColumnRenamed("t", "text").select(*base.columns), SF)
    assert all(r["text"].count("once") <= 1 for r in cut.collect())


def test_pipeline_keeps_clean_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0.8 * docs.count() < got.count() <= docs.count()


def test_pipeline_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    given = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    clean = [r for r in base.where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    text = " ".join(f"{a} {b}" for a, b in zip(clean[0]["text"].split()[:60], clean[1]["text"].split()[:60]))
    odd = [(900_001, text), (900_001, text), (None, text), (None, None), (900_002, None), (900_003, "")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").selectExpr(
        *[c if c in ("doc_id", "text") else f"CAST(NULL AS {t}) AS {c}" for c, t in given.items()]
    )
    docs = base.unionByName(rows)
    for name in ("_key", "_key_", "_doc", "_gone", "fp", "rejected", "component_id", "h", "id", "shard"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.where("doc_id IS NULL OR doc_id > 900000").collect()} == {None, 900_001}
    kept = corpus_pipeline.without_repeated_lines(spark, kept, SF)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    found = kept.where("doc_id IS NULL OR doc_id > 900000").collect()
    # One of three copies, and what has no fingerprint.
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found) == [(0, ""), (900_001, text), (900_002, ""), (900_003, "")]
    phrase = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    dirty = docs.limit(1).selectExpr(*[f"'{phrase}' AS text" if c == "text" else "CAST(NULL AS BIGINT) AS doc_id" if c == "doc_id" else c for c in docs.columns])
    assert corpus_pipeline.uncontaminated(spark, dirty, SF).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
