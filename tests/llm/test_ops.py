"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprint, html_text, license_scan, line_dedup, mixing, neighbours, packing, quality, sharding
from quire.llm.common import top

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, size string, row string, label string, n_lines string"


def frame(spark, rows):
    """rows of (doc_id, text, source), with columns of clashing names."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "h", "z", "r", "l", "n") for d, t, s in rows], SCHEMA)


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows = [(i, " ".join(words(r, int(r.paretovariate(0.9) * 12))), f"s{min(r.randrange(9), 4)}") for i in range(300)]
    rows += [(400, None, "s1"), (401, "", None), (402, "one", None), (None, "no id here", "s0"), (403, " \n\t", "s0"), (404, " ".join(words(r, 30_000)), "s2")]
    rows += [(500 + i, rows[0][1], "s0") for i in range(150)] + [rows[1]] * 3
    return rows


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_sharding(spark, corpus):
    got = sharding.shard(frame(spark, corpus), 8).collect()
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    plain = {(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in corpus}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == plain and {r.law for r in got} == {"bytes"}
    assert sharding.shard(frame(spark, []), 4).count() == 0
    # without one text that outweighs a shard, copies stay together and shards are even
    rest = [x for x in corpus if len(x[1] or '') < 20_000]
    got = sharding.shard(frame(spark, rest), 4).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.05 * sum(loads.values()) / 4
    copies = {r.shard for r in got if r.text_crc32 == zlib.crc32(corpus[1][1].encode())}
    assert len(copies) == 1


def test_sharding_of_repeated_rows_and_rows_without_ids(spark, tmp_path):
    r = random.Random(3)
    heavy, rest = " ".join(words(r, 900)), [(i, " ".join(words(r, 90)), "s") for i in range(400)]
    for rows in ([(7, heavy, "s")] * 400 + rest, [(None, heavy, "s")] * 400 + rest, [(1000 + i, heavy, "s") for i in range(400)] + rest):
        loads, slots = Counter(), defaultdict(list)
        for x in sharding.shard(frame(spark, rows), 8).collect():
            loads[x.shard] += x.size
            slots[x.shard].append(x.slot)
        assert max(loads.values()) < 1.05 * sum(loads.values()) / 8 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    rows, path = sharding.slotted(sharding.sized(frame(spark, rest)), 8).cache(), str(tmp_path / "m")
    old = {x.vslot: x.shard for x in sharding.shard(frame(spark, rest), 8, map_path=path).select("vslot", "shard").distinct().collect()}
    new = {x.vslot: x.shard for x in sharding.rebalance(rows, path, 1, 8).collect()}
    assert all(new[s] in (shard, 8) for s, shard in old.items()) and 8 in new.values()
    assert {x.vslot: x.shard for x in sharding.shard(frame(spark, rest), 9, map_path=path, version=2).collect()}.items() <= new.items()


def test_slot_map_grows_into_the_new_shard_only(spark, tmp_path):
    loads = {s: random.Random(s).randrange(1, 100) for s in range(512)}
    owner = sharding.assign(loads, 8, 512)
    grown = sharding.grow(owner, loads, 8)
    assert all(grown[s] in (owner[s], 8) for s in owner)
    part = sum(loads[s] for s in grown if grown[s] == 8)
    assert 0.9 < part / (sum(loads.values()) / 9) < 1.1
    sharding.save_map(spark, owner, str(tmp_path / "m"), 1)
    sharding.save_map(spark, grown, str(tmp_path / "m"), 2)
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "m"), 2).collect()} == grown


def water(sums, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    w, goal, target, free = {s: weights[i % 3] for i, s in enumerate(names)}, share * sum(sums.values()), {}, set(names)
    while free:
        rest = goal - sum(target.values())
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > most * sums[s]]
        if not over:
            return target | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: most * sums[s] for s in over}
        free -= set(over)
    return target


def test_mixing(spark, corpus):
    df = frame(spark, corpus)
    got = mixing.mix(df).collect()
    sums = Counter()
    for _, t, s in corpus:
        sums[s] += size_of(t)
    want, taken = water(sums), Counter()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size_of(t)) for d, t, _ in corpus)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    for s in sums:
        sizes = [size_of(t) for _, t, x in corpus if x == s]
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], max(sizes) / 2)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))
    # unequal odds: of a source that gives a part of its documents, longer ones are taken oftener
    many = spark.createDataFrame([(i, " ".join(["w"] * (10 if i % 2 else 160)), f"s{i % 3 // 2}") for i in range(6000)], "doc_id long, text string, source string")
    part = [r for r in mixing.mix(many).collect() if 0 < r.target % r.source_size < r.source_size]
    rate = {n: np.mean([x.copies for x in part if x["size"] == n and x.source == "s1"]) for n in (10, 160)}
    assert rate[160] > 1.5 * rate[10] or rate == {10: 2, 160: 2} or rate[160] - int(rate[160]) > 1.5 * (rate[10] - int(rate[10]))
    kept = mixing.keep(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect() if size_of(r.text)) == Counter({d: n for d, n in Counter(x for r in got for x in [r.doc_id] * r.copies if r["size"]).items()})
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.keep(frame(spark, [])).count() == 0


def test_packing(spark, corpus):
    got = packing.pack(frame(spark, corpus), buckets=5, budget=2000).collect()
    assert Counter((r.doc_id, r.tokens) for r in got) == Counter((d, size_of(t)) for d, t, _ in corpus)
    batches = defaultdict(list)
    for r in got:
        assert r.tokens <= r.bucket_tokens
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert sorted(r.place for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].bucket_tokens <= 2000
    for b in {b for b, _ in batches}:
        assert sorted(n for x, n in batches if x == b) == list(range(len([1 for x, _ in batches if x == b])))
    assert packing.pack(frame(spark, [])).count() == 0


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(30):
        x = sorted(r.sample(range(100), r.randint(1, 9)))
        c, k = [r.randint(1, 9) for _ in x], r.randint(1, 4)
        cost = lambda ends: sum(n * (min(e for e in ends if e >= v) - v) for v, n in zip(x, c))
        best = min((cost([*s, x[-1]]) for m in range(min(k, len(x))) for s in __import__("itertools").combinations(x[:-1], m)), default=0)
        got = packing.boundaries(x, c, k)
        assert len(got) <= k and cost(got) == best


def test_fingerprints(spark, corpus):
    rows = [(i if d is not None else None, t, s) for i, (d, t, s) in enumerate(corpus)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
    prints = defaultdict(set)
    for (d, t, _), (_, after, _) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        cut = len(t) // 3
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1.0 or t != after)
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    # the sketches themselves, from hashes of the words
    some = [i for i in range(0, 300, 7)]
    vocabulary = sorted({w for i in some for w in (dict((d, t) for d, t, _ in rows)[i] or "").lower().split()})
    code = {x.w: x.h for x in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    sets = {i: [[code[w] for w in t.lower().split()][j : j + 5] for j in range(max(0, len(t.split()) - 4))] for i, t, _ in rows if i in some}
    flat = spark.createDataFrame([(i, *g) for i, gs in sets.items() for g in gs], "i long, a long, b long, c long, d long, e long").select("i", F.xxhash64("a", "b", "c", "d", "e").alias("h"))
    plain = defaultdict(set)
    for x in flat.collect():
        plain[x.i].add(x.h)
    for i in some:
        if len(sets[i]) > 0:
            assert got[i].fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(plain[i])[:64])
    long = [got[i] for i in range(300) if got[i].n_chars > 300]
    assert np.mean([r.near_edited > r.near_next or r.near_next == 1 for r in long]) > 0.99
    # one id, or none, for a third of all rows: each row's next one is another of the group
    same = [(None if i % 2 else 5, f"text number {i} of its own words w{i}", "s") for i in range(200)] + [(i, f"w{i}", "s") for i in range(10, 60)]
    df = frame(spark, same).withColumn("_k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_t", F.xxhash64("text"))
    for n in (1, 7, 40):
        after = {x.text: x.next_text for x in fingerprint.with_next(df, ["text"], n).collect()}
        assert sorted(after) == sorted(after.values()) == sorted(t for _, t, _ in same)
        by = sorted(((r._k, r._t, r.text) for r in df.collect()), reverse=True)
        assert all(after[x[2]] == y[2] for x, y in zip(by, [*by[1:], by[0]]))
    one = fingerprint.fingerprints(frame(spark, [(1, "a b c", "s")])).first()
    assert one.near_next == 1.0 and fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_sketch_estimates(spark):
    r = random.Random(2)
    a, b = words(r, 900), words(r, 300)
    df = spark.createDataFrame([(" ".join(a + b), " ".join(a), " ".join(b))], "x string, y string, z string")
    for c in "xyz":
        df = fingerprint.with_sketch(df, c, f"s{c}", 256)
    s = [F.col(f"s{c}") for c in "xyz"]
    row = df.select(fingerprint.resemblance(s[0], s[1], 256).alias("j"), fingerprint.containment(s[1], s[0], 256).alias("c"), fingerprint.distinct_count(s[0], 256).alias("n"), (fingerprint.merged(s[1], s[2], 256) == s[0]).alias("m"), F.size(F.array_except(s[0], fingerprint.merged(s[1], s[2], 256))).alias("lost")).first()
    assert abs(row.j - 896 / 1196) < 0.1 and row.c > 0.85 and abs(row.n / 1196 - 1) < 0.2 and row.lost <= 8


def brute_lines(rows, least):
    """Every line against every earlier line: the longest run of equal lines around the two goes if it has enough words."""
    out, before = [], []
    for d, t in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        full = [(x.strip(" \t\x0b\x0c\r"), len(x.split()), i) for i, x in enumerate(lines) if x.split()]
        for other in [*before, full]:
            for a in range(len(full)):
                for b in range(a if other is full else len(other)):
                    if full[a][0] == other[b][0] and (not a or not b or full[a - 1][0] != other[b - 1][0]):
                        n = 0
                        while a + n < len(full) and b + n < len(other) and full[a + n][0] == other[b + n][0]:
                            n += 1
                        if sum(w for _, w, _ in full[a : a + n]) >= least:
                            gone |= set(range(full[a][2], full[a + n - 1][2] + 1))
        before.append(full)
        out += [(d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))] * rows.count((d, t))
    return sorted(out, key=str)


def test_line_dedup(spark):
    r = random.Random(3)
    pool = [" ".join(words(r, r.choice([1, 2, 3, 5, 9, 40]))) for _ in range(25)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n".join(["same line here"] * 30)), (103, rows[3][1]), (None, rows[4][1])]
    df = frame(spark, [(d, t, "s") for d, t in rows])
    got = sorted(((x.doc_id, x.text, x.n_deleted) for x in line_dedup.dedup(df, 8).collect()), key=str)
    assert got == brute_lines(rows, 8)
    kept = line_dedup.keep(df, 8)
    assert kept.columns == df.columns and all(x.n_chars == len(x.text or "") for x in kept.collect())
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(((d, t) for d, t, n in brute_lines(rows, 8) if not n or t.split()), key=str)
    twice = line_dedup.dedup(frame(spark, [(1, pool[0] + " a b c d e f g h i", "s")] * 2), 8).collect()
    assert len(twice) == 2 and all(x.n_deleted == 0 for x in twice)
    assert line_dedup.dedup(frame(spark, []), 8).count() == 0
    # closing lines of a repeated run go too, whatever follows; so do repeats in repeated rows and in a very long text
    run = lambda *n: "\n".join(" ".join(f"{k}x{i}" for i in range(m)) for k, m in enumerate(n))
    long = "\n".join(" ".join(words(r, 9)) for _ in range(20_000))
    rows = [(1, run(60, 20) + "\nhere"), (2, run(60, 20) + "\nthere and more"), (3, "a\n" + run(30, 10, 15) + "\nb"), (4, "c d\n\n" + run(30, 10, 15) + "\nd"), (9, run(60, 20)), (9, run(60, 20))]
    got = sorted(((x.doc_id, x.text, x.n_deleted) for x in line_dedup.dedup(frame(spark, [(d, t, "s") for d, t in rows])).collect()), key=str)
    assert got == brute_lines(rows, 32) and [g[1] for g in got if g[0] in (2, 4, 9)] == ["there and more", "c d\n\nd", "", ""]
    twice = line_dedup.dedup(frame(spark, [(1, long, "s"), (2, long[: len(long) // 2] + "\nnew", "s")])).collect()
    assert {x.doc_id: x.n_deleted for x in twice}[1] == 0 and len({x.doc_id: x.text for x in twice}[2].split("\n")) <= 3


def test_line_dedup_goes_through_its_fingerprints(spark, monkeypatch):
    text = "\n".join(f"line {i} of some words in it" for i in range(40))
    df = frame(spark, [(1, text, "s"), (2, "x\n" + text, "s")])
    marks = line_dedup.fingerprints(df)
    assert 0 < marks.filter(F.col("_id") == 1).count() < 30  # selected lines, not all
    plain = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda *a: plain(*a).withColumn("mark", F.xxhash64("_id", "mark")))
    assert line_dedup.dedup(df).agg(F.sum("n_deleted")).first()[0] == 0


def test_license_scan(spark):
    r = random.Random(4)
    fill = lambda n: " ".join(words(r, n))
    t = license_scan.TEMPLATES
    bsd, other = t["BSD"].split(), t["BSD"].split()
    bsd[-1] = "changed"  # one shingle of twenty is lost
    other[5::5] = ["changed"] * len(other[5::5])  # nearly all are
    rows = [(1, fill(50) + " " + t["MIT"].upper() + " " + fill(9)), (2, fill(700) + "\n" + t["MIT-grant"] + fill(30)), (3, t["GPL-3.0"]), (4, fill(40) + " ".join(["", *bsd])), (10, fill(40) + " ".join(["", *other])), (11, fill(1000) + " " + t["Zlib-text"].replace("freely", "at will")), (5, fill(300)), (6, None), (7, ""), (8, "mit license"), (9, t["CC-BY-NC-4.0"] + " " + fill(20) + " " + t["GPL-2.0"] + " " + fill(60) + t["GPL-3.0"]), (1, None)]
    found = license_scan.scan(frame(spark, [(d, x, "s") for d, x in rows])).collect()
    got, place = {(x.doc_id, x.license) for x in found}, {(x.doc_id, x.license): x.first_word for x in found}
    assert got == {(1, "MIT"), (2, "MIT-grant"), (3, "GPL-3.0"), (4, "BSD"), (9, "CC-BY-NC-4.0"), (9, "GPL-2.0"), (9, "GPL-3.0"), (11, "Zlib-text")}
    assert place[1, "MIT"] == 50 and place[2, "MIT-grant"] == 700 and place[4, "BSD"] == 40 and place[3, "GPL-3.0"] == 0 and place[11, "Zlib-text"] == 1000
    long = fill(300_000) + " " + t["ISC-text"] + " " + fill(300_000)
    assert sorted((x.license, x.first_word) for x in license_scan.scan(frame(spark, [(1, long, "s")])).collect()) == [("ISC", 300_000), ("ISC-text", 300_000)]
    assert license_scan.scan(frame(spark, [])).count() == 0 and license_scan.scan(frame(spark, [(1, "x", "s")]), {"short": "two words"}).count() == 0


def test_license_bands_equal_plain_containment(spark):
    r = random.Random(6)
    plates = {f"t{i}": " ".join(words(r, n)) for i, n in enumerate([5, 6, 9, 14, 30, 70])}
    rows = []
    for i in range(60):
        p = plates[f"t{r.randrange(6)}"].split()
        if r.random() < 0.4:
            p[r.randrange(len(p))] = "edit"
        rows.append((i, " ".join(words(r, r.randrange(200)) + p + words(r, r.randrange(200)))))
    sh = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    want = set()
    for d, t in rows:
        w = t.split()
        for name, p in plates.items():
            ps = sh(p.split())
            n = license_scan.width(len(ps))
            every = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
            if any(100 * len(ps & set(every[s : s + n])) >= 75 * len(ps) for s in range(0, len(every), n // 2)):
                want.add((d, name))
    got = {(x.doc_id, x.license) for x in license_scan.scan(frame(spark, [(d, t, "s") for d, t in rows]), plates).collect()}
    assert got == want and len(want) > 30


PAGE = '<html><body class="has-sidebar"><header><h1>Site</h1><nav>m</nav></header><div id="cookie-notice">we use <b>cookies</b></div><div class="content"><h1>Title &amp; more</h1><p>First para&nbsp;of text here with words.</p><div class="ad"><p>buy now</p></div><p>Second<br>para <a href=x>link</a> text. 1 < 2</p><form><p>Sign</p></form><p>x</p></div><aside>side</aside><section id="comments"><article class="comment"><p>nice post words words</p></article></section><footer>(c)</footer></body></html>'
MARKED = "<body><nav><ul><li>home<article><h1>T</h1><p>one\n two<p>three</article><p>after<footer>f"


def test_html_text(spark):
    want = "Title & more\nFirst para of text here with words.\nSecond para link text. 1 < 2\nx"
    rows = [(1, "u", PAGE), (2, "u", MARKED), (3, None, None), (4, "u", ""), (5, "u", "<p>cut off <a hr"), (6, "u", MARKED), (6, "u", MARKED), (7, "u", '<article><div class="post-header"><h1>H</h1></div><p class="ad">buy<p>text</article>')]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, want, len(want)), (2, "T\none two\nthree", 15), (3, "", 0), (4, "", 0), (5, "cut off", 7), (6, "T\none two\nthree", 15), (6, "T\none two\nthree", 15), (7, "H\ntext", 6)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ('<ul><li class="ad">buy<li>one two three four</ul><p>more words follow here', "one two three four\nmore words follow here"),
        ('<div><p>first words here</p><div class=ad>buy now<p>the text goes on and on</p><p>to the end', "first words here\nthe text goes on and on\nto the end"),
        ('<p>some text <span class=promo>buy</p><p>then the rest of it', "some text\nthen the rest of it"),
        ('<article><p>intro text here</p><section id="related-work"><h2 id="related">Related work</h2><p>others did this</p></section><div class="share-price">up 3</div></article>', "intro text here\nRelated work\nothers did this\nup 3"),
        ("<article><p>one one</p></article><div><p>between them</p><p>more between</p></div><article><p>two two</p></article>", "one one\ntwo two"),
        ("<body><form action=x><nav><a href=a>menu</a></nav><div><p>all the words of the page are in here</p><p>and here too</p></div></form></body>", "all the words of the page are in here\nand here too"),
        ('<article class="article social-science"><p>text of it</p></article>', "text of it"),
        ('<div class="layout with-sidebar"><p>words of the page stand here</p><div class="sidebar">side</div></div>', "words of the page stand here"),
        ('<body class="comments-open"><article class="comments-open"><p>text of it</p></article><div class="comment-list"><p>so nice a text to read it is</p></div></body>', "text of it"),
        ('<aside class="related-posts"><article><p>teaser</p></article></aside><article><p>the text</p></article>', "the text"),
        ('<div id="cookie-notice"><p>we use cookies</p></div><div class="site-nav">a b</div><div><p>the text has these words</p></div><div class="reader-comments"><p>' + "nice " * 90 + "</p></div>", "the text has these words"),
        ("<table><tr><td>a cell<td class=ad>buy<td>next cell<tr><td>last one</table>", "a cell\nnext cell\nlast one"),
        ("<div><b>never closed <p>words here</p></div><footer>f</footer>" + "<span>" * 3000 + "</i>" * 3000, "never closed\nwords here"),
    ],
)
def test_main_text_loses_nothing(html, want):
    assert html_text.main_text(html, {}) == want


def test_very_long_page():
    html = "<nav>menu</nav><div>" + "".join(f"<p>word number {i} of the page<br>goes on" for i in range(60_000)) + "</div><footer>f</footer>"
    got = html_text.main_text(html, {})
    assert got.count("\n") == 59_999 and got.endswith("word number 59999 of the page goes on")


def test_text_of_pages_whose_article_element_is_hidden(spark):
    """Held-out agreement: pages are read with their article tags taken for plain divisions, by weights from other pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = html_text.learn(pages.filter("page_id % 2 = 0"))
    hit = found = there = 0
    for r in pages.filter("page_id % 2 = 1").collect():
        want = Counter(html_text.main_text(r.html, w).split())
        got = Counter(html_text.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html), w).split())
        hit, found, there = hit + (want & got).total(), found + got.total(), there + want.total()
    assert 2 * hit / (found + there) >= 0.95


def test_best_run_is_the_best():
    r = random.Random(1)
    for _ in range(200):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 9))]
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_quality(spark):
    r = random.Random(7)
    good = lambda: " ".join(f"the{r.randrange(300)} of and{r.randrange(40)}" for _ in range(r.randint(5, 80)))
    bad = lambda: r.choice([" ".join(f"x{r.randrange(300)}!!! %%%" for _ in range(40)), "spam " * 60])
    rows = [(i, good() if i % 4 else bad(), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, " ", "s"), (None, good(), "s"), (904, good() * 400, "s")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0, "x") for i in range(0, 400, 2)] + [(None, 1, 0, "x"), (5, None, 1, "x"), (9999, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = {x.doc_id: x for x in quality.score(df, labels).collect()}
    held = [i for i in range(400) if i % 2]  # never labelled
    assert np.mean([got[i].chosen == (i % 4 > 0) for i in range(400)]) > 0.98 and np.mean([got[i].chosen for i in held]) > 0.98
    assert got[904].chosen and got[None].chosen and not any(got[i].chosen or got[i].n_grams for i in (900, 901, 902))
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(x.chosen for x in got.values())
    assert quality.score(df.limit(0), labels).count() == 0
    assert quality.keep(df, labels.limit(0)).count() == len(rows) - 3


def test_exact_top(spark):
    r = random.Random(8)
    rows = [(i, float(r.choice([1, 2, 2, 3, 9, float("-inf")]) + r.random() * (i % 3))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key double")
    for k in (0, 1, 77, 499, 500, 900):
        got = {x.id for x in top(df, "key", k, "id", cells=16).filter("chosen").collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:k]}
    same = spark.createDataFrame([(7, 1.0)] * 50 + [(8, 2.0), (9, 1.0)], "id long, key double")
    assert [top(same, "key", k, "id").filter("chosen").count() for k in (1, 2, 51, 52)] == [1, 51, 51, 52]


def plain_quality(rows, labels, buckets, sample, length):
    """n_grams and log_ratio of each row by Python's own loops over words and bytes."""
    import pandas as pd

    M = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & M
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & M
        return x ^ x >> 33

    def grams(t):
        t = t or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        h = [int(x) for x in pd.util.hash_array(np.array([x.encode() for x in w], object), categorize=False)] if w else []
        b = t.encode()
        return [mixed(x) % buckets for x in h] + [mixed((x * 3 + y) & M) % buckets for x, y in zip(h, h[1:])], [mixed(int.from_bytes(b[i : i + 4], "little")) % buckets for i in range(len(b) - 3)]

    raw, target = [[1] * buckets, [1] * buckets], [[1] * buckets, [1] * buckets]
    for d, t in rows:
        for kind, g in enumerate(grams(t)):
            for x in g:
                raw[kind][x] += 1
                target[kind][x] += labels.get(d) == 1
    w = [[math.log(target[k][x] / sum(target[k]) / (raw[k][x] / sum(raw[k]))) for x in range(buckets)] for k in (0, 1)]
    return [(d, len(grams(t)[0]), sum(sum(w[k][x] for x in g) / max(1, len(g)) for k, g in enumerate(grams(t))) * length / 2 if grams(t)[0] else 0.0) for d, t in rows]


def test_quality_equals_plain_python(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, " ".join(words(r, r.randint(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (72, "é ß\u00a0x Ab AB"), (None, "a b c")]
    labels = {i: int(i % 3 > 0) for i in range(40)}
    df = frame(spark, [(d, t, "s") for d, t in rows])
    lab = spark.createDataFrame([(d, q, 0) for d, q in labels.items()], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "RUN", 64)  # runs end inside texts
    apart = {x._lid for x in lab.select(F.col("doc_id").alias("_lid")).filter(F.pmod(F.xxhash64(F.lit(12), "_lid"), F.lit(3)) == 0).collect()}
    want = plain_quality(rows, {d: q for d, q in labels.items() if d not in apart}, 256, 100, 512)
    got = sorted(((x.doc_id, x.n_grams, x.log_ratio) for x in quality.score(df, lab, buckets=256).collect()), key=str)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-2


def test_very_long_text_in_bounded_memory():
    """One text of 50 MB: n-grams and shingles beside it take a bounded part of its size."""
    import resource
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from quire.llm import quality, shingling
r = np.random.RandomState(0)
text = " ".join(f"w{x}" for x in r.randint(0, 50000, 1 << 20)) * 8
t = pa.array([text], pa.string())
size = len(text); del text
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(x) for _, x, _ in quality.grams(t, 1 << 16))
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert n > size, n
h, start = shingling.shingle_sets(t)
last = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(size // 1024, peak - base, last - base, len(h))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 3)[0]).stdout.split()
    size, grams_kb, sets_kb = int(out[0]), int(out[1]), int(out[2])
    assert size > 45_000 and grams_kb < 5 * size and sets_kb < 9 * size and int(out[3]) > 1_000_000
    assert resource.RUSAGE_SELF == 0


def test_long_text_in_pieces_has_the_same_words(monkeypatch):
    from quire.llm import shingling

    import pyarrow as pa

    r = random.Random(9)
    text = "  ".join([*words(r, 4000), "x" * 500, "É" * 90, *words(r, 500)]) + " \n"
    whole = [z.tolist() for z in (*shingling.word_hashes(pa.array([text, None])), *shingling.shingle_sets(pa.array([text])))]
    monkeypatch.setattr(shingling, "PIECE", 64)
    monkeypatch.setattr(shingling, "RUN", 100)
    again = [z.tolist() for z in (*shingling.word_hashes(pa.array([text])), *shingling.shingle_sets(pa.array([text])))]
    assert again[0] == whole[0] and again[1] == whole[1][:2] and again[2:] == whole[2:]


def test_neighbours(spark):
    r = np.random.RandomState(1)
    centres = r.randn(6, 24)
    x = (centres[r.randint(0, 6, 1500)] + 0.7 * r.randn(1500, 24)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]  # copies
    rows += [(3000, None), (3100, [0.0] * 24), (3200, [float("nan")] + [1.0] * 23), (3300, [None] + [1.0] * 23), (3400, [1.0]), (None, rows[3][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(*v, "z") for v in rows], "vec_id long, embedding array<float>, node string")
    fit = {i: np.float64(np.float32(v)) for i, v in rows[:1560]}
    got = defaultdict(list)
    for g in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.vec_id, g.score, g["rank"]))
    assert sorted(got) == sorted(i for i in fit if i % 100 == 0)
    hit = 0
    ids = np.array(list(fit))
    every = np.stack(list(fit.values()))
    for q, found in got.items():
        d = np.sqrt(((every - fit[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [g[2] for g in found] == list(range(1, 11)) and [(g[1], g[0]) for g in found] == sorted((g[1], g[0]) for g in found)
        assert all(abs(np.sqrt(((fit[v] - fit[q]) ** 2).sum()) - s) < 1e-9 for v, s, _ in found)
        hit += len({ids[i] for i in order} & {g[0] for g in found})
    assert hit / (10 * len(got)) >= 0.95
    assert [g[0] for g in got[2000]] == [7, *range(2001, 2010)]
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.filter("vec_id in (100, 3)")).count() == 1


@pytest.mark.parametrize("few", [10**9, 60])
def test_neighbours_at_equal_distance_go_by_id(spark, monkeypatch, few):
    monkeypatch.setattr(neighbours, "CELL", few)
    n = 160
    df = spark.createDataFrame([(i * 10, [float(i == j) for j in range(n)]) for i in reversed(range(n))], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for g in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[g.query_id].append(g.vec_id)
    assert got == {q: [v for v in range(0, 120, 10) if v != q][:10] for q in range(0, 10 * n, 100)}


def test_neighbours_recall_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 150)
    r = np.random.RandomState(5)
    x = (r.randn(40, 32)[r.randint(0, 40, 8000)] + 0.8 * r.randn(8000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for g in neighbours.nearest(df).collect():
        got[g.query_id].add(g.vec_id)
    hit = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hit += len(set(np.argsort(d)[1:11]) & found)
    assert len(got) == 80 and hit / 800 >= 0.9


def test_neighbours_in_a_dense_group_beside_a_large_vector(spark):
    r = np.random.RandomState(2)
    x = np.concatenate([r.randn(1, 16) + 1e-4 * r.randn(1000, 16), r.randn(200, 16), np.full((1, 16), 1e6)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, hit = defaultdict(set), 0
    for g in neighbours.nearest(df, every=100).collect():
        got[g.query_id].add(g.vec_id)
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hit += len(set(np.argsort(d)[1:11]) & found)
    assert len(got) == 13 and hit / (10 * len(got)) >= 0.95


def test_sweep(spark):
    from quire.llm import common

    df = common.stash(spark.range(3))
    assert df.count() == 3
    common.sweep(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_packing_by_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = [(1, "one two  three", "s"), (2, None, "s"), (3, "<|endoftext|>", "s"), (4, "", "s")]
    got = {r.doc_id: r.tokens for r in packing.pack(frame(spark, rows), tokenizer=path).collect()}
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert got == {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x, _ in rows} and got[3] > 1


@pytest.mark.parametrize("few", [64, 0])
def test_cells_are_divided_until_small(spark, monkeypatch, few):
    monkeypatch.setattr(neighbours, "FEW", few)
    r = np.random.RandomState(2)
    nodes = spark.createDataFrame([(i, [float(v) for v in r.randn(8)]) for i in range(900)], "node long, x array<double>")
    codes = neighbours._coded(nodes, "float64")
    got = neighbours._cells(codes, "float64", 0, pivots=4, cell=20).toPandas()
    assert sorted(got.node) == list(range(900)) and got.groupby(["cell", "part"]).size().max() <= 80 and got.cell.nunique() > 16
    graph = neighbours.build(nodes, k=8, pivots=4, cell=20).toPandas()
    x = np.stack([n.x for n in nodes.orderBy("node").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :8]
    assert np.mean([len(set(near[a]) & set(g.b)) / 8 for a, g in graph.groupby("a")]) > 0.85
