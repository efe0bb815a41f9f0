import hashlib

from lectern.llm import lines
from lectern.llm.queries import QUERIES


def one_edit_apart(a, b):
    """At most one word put in, taken out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, min_words=5):
    """What is kept of each (id, text), by comparing every line with all of smaller ids and those before it.

    Equal lines go whatever their length, lines one edit apart if both have ``min_words`` words.
    """
    out = set()
    lines = [(doc_id, n, line.encode().split()) for doc_id, text in rows if doc_id is not None for n, line in enumerate((text or "").split("\n"))]
    for doc_id, text in rows:
        kept = []
        own = [] if doc_id is None else [words for other, _, words in lines if other < doc_id]
        for line in (text or "").split("\n"):
            words = line.encode().split()
            near = any(w == words or min(len(w), len(words)) >= min_words and one_edit_apart(w, words) for w in own)
            if doc_id is None or not words or not near:
                kept.append(line)
            if doc_id is not None:
                own.append(words)
        out.add((doc_id, "\n".join(kept)))
    return out


def kept_of(df):
    return {(r["doc_id"], r["text"] or "") for r in df.collect()}


def test_small_cases(spark):
    base = "one two three four five six seven"
    rows = [
        (1, base),
        (2, "one two three four five six seven\nnew line that is all its own here\n"),
        (3, "one two THREE four five six seven\nshort line\nshort line"),
        (4, "two three four five six seven\n" + base + " eight"),
        (5, "one two THREE four FIVE six seven"),
        (6, None),
        (7, ""),
        (None, base),
        (8, "x " * 40_000 + "\n" + "x " * 39_999 + "y"),
    ]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, h string")
    got = lines.cut_lines(docs)
    assert kept_of(got) == plain(rows)
    assert "h" in got.columns
    assert lines.cut_lines(docs.limit(0)).count() == 0


def test_query_equals_brute_force_on_part(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {(r["doc_id"], r["kept_sha256"]) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(d, hashlib.sha256(k.encode()).hexdigest()) for d, k in plain(rows)}


def test_short_lines_and_text_without_blanks(spark):
    """Exact repeats go at any length; one edit from five words, or ten characters without blanks, on."""
    rows = [
        (1, "Menu\nRead more\n我们今天在图书馆里看了一本书\n我们今天\nสวัสดีชาวโลกทั้งหลาย\n\n \nalone"),
        (2, "Menu\nRead  more\nRead less\n我们昨天在图书馆里看了一本书\n我们昨天\nสวัสดีชาวโลกทั้งหลาย\n\n \nMenu"),
        (3, "我们今天在图书馆里看了一本书\n我们今天在学校里看了一本书\nnew\nnew"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_of(lines.cut_lines(docs)) == {
        (1, rows[0][1]),
        (2, "Read less\n我们昨天\n\n "),
        (3, "我们今天在学校里看了一本书\nnew"),
    }


def test_several_texts_under_one_id(spark):
    """Each row loses its own lines, repeated rows lose the same."""
    rows = [
        (1, "first line of the five words\nmenu"),
        (1, "menu\nfirst line of the six words"),
        (2, "something else altogether stands here\nmenu\nfirst line of the five words"),
        (2, "menu\nsomething new that stands nowhere else\nmenu"),
        (2, "menu\nsomething new that stands nowhere else\nmenu"),
    ]
    for order in (rows, rows[::-1]):
        got = lines.cut_lines(spark.createDataFrame(order, "doc_id long, text string").repartition(3))
        assert kept_of(got) == plain(rows)
        assert got.count() == 5
