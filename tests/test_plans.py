import docs
import pytest
from pyspark.sql import functions as F

from quire.operators import anchors
from quire.plans import config, convert
from quire.sources import readers, registry


@pytest.fixture
def folder(tmp_path):
    put = {"memo.docx": docs.docx(), "deck.pptx": docs.pptx(), "b.epub": docs.epub(), "o.odt": docs.odt(), "a.rtf": docs.RTF, "p.html": docs.HTML.encode(), "m.md": docs.MD.encode(), "pic.png": docs.PNG, "m.txt": b"plain", "Title.csv": b"a,b\n1,2\n", "bad.docx": b"x", "r.pdf": docs.pdf()}
    for name, data in put.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_convert_and_check(spark, folder, tmp_path):
    files = registry.files(spark, str(folder))
    made = convert.convert(files).cache()
    by = {r.path.rsplit("/", 1)[-1]: r for r in made.collect()}
    assert len(by) == 11 and by["bad.docx"].error and by["bad.docx"].md is None
    assert by["p.html"].md.count("![a-b-h02-img01: local](images/a-b-h02-img01.png)") == 1
    assert "*[a-b-h02-img03 — linked image file not found]*" in by["p.html"].md and by["p.html"].images == 1 and by["p.html"].placeholders == 4
    assert by["m.txt"].md == "# m\n\nplain\n" and by["memo.docx"].md.startswith("# Overview\n\nSome text.\n\n![quarterly-memo-h01-img01: A caption](images/")
    images = readers.with_linked(readers.read_files(files.filter(registry.is_supported(F.col("path")))), files)
    done = convert.write_tree(convert.placed(made), images, str(tmp_path / "out")).collect()
    assert all(r.error is None for r in done) and (tmp_path / "out/a-b/images/a-b-h02-img01.png").read_bytes() == docs.PNG
    assert all(r.error for r in convert.write_tree(convert.placed(made), images, str(tmp_path / "out")).collect())
    assert all(r.error is None for r in convert.write_tree(convert.placed(made), images, str(tmp_path / "out"), True).collect())
    names = images.filter("data is not null").select(F.col("path").alias("doc_id"), F.concat("id", "ext").alias("filename"))
    assert anchors.problems(made.filter("error is null").select(F.col("path").alias("doc_id"), "md"), names).count() == 0
    off = {r.path.rsplit("/", 1)[-1]: r for r in convert.convert(files, config.ConvertConfig(extract_images=False)).collect()}
    assert off["p.html"].images == 0 and "*[a-b-h02-img01 — image extraction disabled: local]*" in off["p.html"].md
    assert len(convert.report(made).collect()) == 11


def test_summaries_and_listing(spark, folder):
    made = convert.convert(registry.files(spark, str(folder))).filter("error is null")
    done = {r.doc_id.rsplit("/", 1)[-1]: r for r in convert.summarize(made).collect()}
    assert done["m.txt"].md.startswith("# Summary of m\n\n# m plain\n\n---\n\n*Summarized from `m.txt` by quire using gpt-5.4 (single pass). 3 words in, 3 out (100%).*")
    order = [r.path.rsplit("/", 1)[-1] for r in registry.convertible(registry.files(spark, str(folder)).select("path")).orderBy("at").collect()]
    assert order[:3] == ["a.rtf", "b.epub", "bad.docx"] and "pic.png" not in order


def test_streaming_converts_what_arrives(spark, folder, tmp_path):
    from quire.streaming.landing import converting

    converting(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 11


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert config.read(config.SummaryConfig, "s.yaml") == config.SummaryConfig()
    with pytest.raises(ValueError):
        config.read(config.SummaryConfig, "s.yaml", tmp_path / "none.yaml")
    for bad in ({"effort": "mad"}, {"min_ratio": 0.5}, {"max_tokens": 0}, {"max_tokens": "9"}, {"target_ratio": 2}, {"carry_context": 1}, {"model": ""}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            config.SummaryConfig(**bad)
    with pytest.raises(ValueError):
        config.ConvertConfig(min_image_pixels=-1)
    assert config.SummaryConfig(min_words=9).but(model="x").values | {} == {**config.SummaryConfig().values, "min_words": 9, "model": "x"}
    yaml = pytest.importorskip("yaml")
    for kind in (config.SummaryConfig, config.ConvertConfig):
        path = config.provide(kind, "s.yaml")
        assert yaml.safe_load(path.read_text()) == kind().values and config.provide(kind, "s.yaml") is None
        path.unlink()
    path.write_text("min_words: 9\nmodle: x\n")
    got = config.read(config.SummaryConfig, "s.yaml")
    assert got.min_words == 9 and got.unknown == ("modle",) and got.origin == path
    for text in ("- a\n", "a: [", "min_words: few\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            config.read(config.SummaryConfig, "s.yaml")


def test_command_line(spark, folder, tmp_path, monkeypatch, capsys):
    from quire.__main__ import main

    home = tmp_path / "cwd"
    home.mkdir()
    monkeypatch.chdir(home)
    monkeypatch.setenv("HOME", str(home))
    two = [str(folder / n) for n in ("m.md", "m.txt")]
    assert main(["convert", *two, "--check", "-v"]) == 0
    said = capsys.readouterr()
    assert (home / "quire-convert.yaml").is_file() and "default settings" in said.err
    assert sorted(p.name for p in (home / "outputs").iterdir() if p.is_dir()) == ["m", "title"] or (home / "outputs" / "m" / "m.md").is_file()
    assert main(["convert", *two]) == 1 and "already exists" in capsys.readouterr().err
    assert main(["convert", str(folder), "--list"]) == 0
    listed = [line.split()[-1].rsplit("/", 1)[-1] for line in capsys.readouterr().out.splitlines()]
    assert listed[0] == "a.rtf" and len(listed) == 11
    assert main(["convert", str(folder), "--select", f"{listed.index('p.html') + 1}", "--outdir", "some"]) == 0
    assert [p.name for p in (home / "some").iterdir()] == ["a-b"] and "1 image(s)" in capsys.readouterr().out
    assert main(["convert", "nothing.pdf"]) == 1 and main(["convert", str(folder), "--select", "99"]) == 1
    assert main(["summarize", two[0], "--model", "m1"]) == 0 and "using m1" in (home / "outputs" / "m.summary.md").read_text()
    monkeypatch.setattr("sys.stdin", ["text-embedding-3\n", "gpt-5.4\n"])
    capsys.readouterr()
    assert main(["summarize", "--list-models"]) == 0 and capsys.readouterr().out.splitlines()[0] == "gpt-5.4"
