import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import batch, blocks, structure, summaries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, slug", [("Annual Report 2026", "annual-report-2026"), ("Café Déjà", "cafe-deja"), ("  a__b  ", "a-b"), ("--x--", "x"), ("", "document"), ("日本", "document"), ("ﬁne ½", "fine-12")])
def test_slugs(spark, text, slug):
    assert one(spark, T.slugify(F.lit(text))) == slug


def test_slug_length_and_names(spark):
    assert len(one(spark, T.slugify(F.lit("a b " * 60)))) <= 60
    assert one(spark, T.title_from_path(F.lit("/x/annual_report-2026.pdf"))) == "annual report 2026"
    assert one(spark, T.suffix(F.lit("/x.y/A.PDF"))) == ".pdf" and one(spark, T.suffix(F.lit("/x.y/none"))) == ""
    assert one(spark, T.clean_caption(F.lit(" a [b]\n c "))) == "a b c"
    assert len(one(spark, T.clean_caption(F.lit("x" * 300)))) == 200
    assert [one(spark, T.human_size(F.lit(n))) for n in (0, 1023, 1024, 5 * 1024**2, 3 * 1024**3)] == ["0 B", "1023 B", "1.0 KB", "5.0 MB", "3.0 GB"]


def test_targets(spark):
    assert [one(spark, T.target_words(F.lit(n))) for n in (0, 1000, 1509, 20_000)] == [150, 150, 150, 2000]
    assert one(spark, T.target_words(F.lit(10_000), ratio=0.9)) == 1500 and one(spark, T.target_words(F.lit(10_000), ratio=0.01)) == 500


def test_code_fences_widen(spark):
    md = one(spark, T.block_markdown(F.lit("code"), F.lit("a ``` b ```` c"), F.lit(0), F.lit("py"), F.lit("")))
    assert md == "`````py\na ``` b ```` c\n`````"


@pytest.mark.parametrize("raw, out", [("3", [2]), ("1,4", [0, 3]), ("2-4", [1, 2, 3]), ("4-2", [1, 2, 3]), ("all", [0, 1, 2, 3, 4, 5]), ("1 1 2", [0, 1]), (" A ", [0, 1, 2, 3, 4, 5])])
def test_selection(raw, out):
    assert batch.parse_selection(raw, 6) == out


@pytest.mark.parametrize("raw", ["0", "7", "x", "1-x", "-2", "2-9"])
def test_bad_selection(raw):
    with pytest.raises(ValueError):
        batch.parse_selection(raw, 6)


def planned(spark, md, **kw):
    return [(r.mode, r.title, r.body) for r in structure.plan(spark.createDataFrame([(1, md)], "doc_id long, md string"), **kw).orderBy("pos").collect()]


def words(n, w="w"):
    return " ".join([w] * n)


def test_plan_modes(spark):
    assert planned(spark, " short ", threshold=5) == [("single", "", "short")]
    md = f"# T\n\n## A\n\n{words(60, 'a')}\n\n## B\n\n{words(60, 'b')}"
    assert [x[:2] for x in planned(spark, md, threshold=50)] == [("chapters", "A"), ("chapters", "B")]
    flat = "\n\n".join([words(30)] * 10)
    got = planned(spark, flat, threshold=50, chunk_words=100)
    assert [x[1] for x in got] == ["Part 1", "Part 2", "Part 3", "Part 4"] and [len(x[2].split()) for x in got] == [90, 90, 90, 30]
    assert len(planned(spark, "\n\n".join([words(30)] * 7 + ["tiny"]), threshold=50, chunk_words=100)) == 3


def test_thin_sections_fold_with_headings_reversed(spark):
    md = f"## A\n\na\n\n## B\n\nb\n\n## C\n\n{words(60, 'c')}\n\n## D\n\n{words(60, 'd')}\n\n## E\n\ne"
    got = planned(spark, md, threshold=10)
    assert got[0][1:] == ("C", f"## B\n\n## A\n\na\n\nb\n\n{words(60, 'c')}") and got[1][1:] == ("D", f"{words(60, 'd')}\n\n## E\n\ne")


def test_front_matter(spark):
    md = f"{words(60, 'f')}\n\n# A\n\n{words(60, 'a')}\n\n# B\n\n{words(60, 'b')}"
    assert [x[1] for x in planned(spark, md, threshold=10)] == ["Front matter", "A", "B"]


def test_summarizer_of_ones_own_carries_context(spark):
    class Echo:
        def complete(self, system, user, text, target):
            if "boom" in text:
                raise RuntimeError("refused")
            return ("seen " if "PREVIOUS" in user else "first ") + " ".join(["w"] * (target - 1)), 10, target

    md = "\n\n".join(f"# {t}\n\n{words(100, w)}" for t, w in (("A", "a"), ("B", "b")))
    bad = md.replace("a a a", "boom a a", 1)
    docs = spark.createDataFrame([(1, md), (2, bad)], "doc_id long, md string")
    rows = summaries.targets(structure.plan(docs, threshold=50), least=10)
    for carry, firsts in ((True, ["first", "seen"]), (False, ["first", "first"])):
        done = summaries.answered(rows, Echo, carry).orderBy("doc_id", "pos").collect()
        assert [r.summary.split()[0] for r in done[:2]] == firsts and done[2].error == "refused"
    assert done[3].error is None
    use = summaries.usage(summaries.answered(rows, Echo, True)).first()
    assert (use.calls, use.input_tokens) == (2, 20) and use.line == "2 request(s), 20 input + 20 output tokens"


def test_demoted_anchor(spark):
    text = "see ![x-img01: c](images/x-img01.png) end"
    assert one(spark, blocks.demoted_text(F.lit(text), F.lit("x-img01"), F.lit(".png"), F.lit("*[x-img01 — gone $1]*"))) == "see *[x-img01 — gone $1]* end"
