import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eqloom.llm import ann, common, decontam, entries, langid, line_dedup, minhash, packing, quality, substring, toxicity, warc
from eqloom.llm.common import plain
from eqloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# names that the operators use inside, to show that they don't clash
EXTRA = "id string, fp string, n_shingles string, kept boolean, score string, component_id string, lang string, source string, n_chars long"
SCHEMA = "doc_id long, text string, " + EXTRA


def rng_text(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(400)) for _ in range(n))


def corpus():
    r = random.Random(3)
    base = [rng_text(r, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 60):
        w = base[i % 6].split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, " \t\n "), (63, "one"), (64, "one"), (65, "one two"), (66, "ONE  two"), (67, base[0].upper()), (3, base[3]), (None, base[5]), (None, None)]
    rows.append((70, " ".join([*base[7].split()[:40], *base[8].split()[:30], *base[7].split()[:40]])))
    rows.append((71, rng_text(r, 30_000)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z", True, "s", "c", "en", "src", 1) for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(1)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400, 400 + i) for i in range(1, 50)] + [(500 + i, 501 + i) for i in range(40)] + [(None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_brute_force(docs, empty, block):
    rows = [(i, t) for i, t in corpus()]

    def shingles(t):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    for _ in range(9):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    out = minhash.near_duplicates(docs, block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = minhash.sketches([a, b, a[:1]], 600)
    assert (s != minhash.FULL).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08


@pytest.mark.parametrize("exact", [24, 1])
def test_lines_brute_force(spark, empty, exact):
    r = random.Random(5)
    base = ["".join(r.choice("abcdef ä") for _ in range(r.randrange(25, 60))).strip() + "xyz0123456789012345678" for _ in range(15)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            s = r.choice(base)
            p, kind = r.randrange(len(s)), r.randrange(5)
            s = {0: s, 1: s[:p] + "Q" + s[p + 1 :], 2: s[:p] + s[p + 1 :], 3: s[:p] + "R" + s[p:], 4: s[:p] + "SS" + s[p:]}[kind]
            lines.append(r.choice([s, s.upper(), "  " + s, "short", ""]))
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (None, base[0]), (5, rows[5][1])]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] <= 1

    every = [((-1 if i is None else i, n), x.strip(" \t\n\r\v\f").lower()) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    first = {}
    for p, x in every:
        first[x] = min(p, first.get(x, p))
    every = [(p, x) for p, x in every if len(x) >= 24]
    df = spark.createDataFrame([(i, t, *["x"] * 2) for i, t in rows], "doc_id long, text string, h string, pos string")
    got = {(x["doc_id"], x["n_lines"], x["n_removed"], x["text"]) for x in line_dedup.dedup_lines(df, exact_chars=exact).collect()}
    want = set()
    for i, t in rows:
        if t is None:
            want.add((i, 0, 0, None))
            continue
        lines = t.split("\n")
        gone = lambda s, p: (len(s) >= exact and first[s] < p) or (len(s) >= 24 and any(q < p and near(s, y) for q, y in every))
        keep = [x for n, x in enumerate(lines) if not gone(x.strip(" \t\n\r\v\f").lower(), (-1 if i is None else i, n))]
        want.add((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_short_lines_of_the_pipeline(spark, sf):
    import corpus_pipeline as p

    long = "a line of more than twenty-four characters"
    rows = [(1, f"Les.\n\n{long}"), (2, f"les. \n\nlex.\n{long}s"), (3, "ä\n \nÄ\nLES.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in p.drop_lines(spark, df, sf).collect()}
    assert got == {1: rows[0][1], 2: "\nlex.", 3: "ä\n "}
    assert {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df).collect()} == {**dict(rows), 2: "les. \n\nlex."}


def test_passages_brute_force(docs, empty):
    import hashlib

    rows = corpus()
    seen = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), set()).add((-1 if i is None else i, s))
    first = {k: min(v) for k, v in seen.items()}
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (-1 if i is None else i, s):
                gone |= set(range(s, s + 20))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(x) for x in substring.dedup_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring.dedup_passages(empty).count() == 0


def test_suffix_automaton(spark):
    r = random.Random(2)
    ref = [[r.choice("abc") for _ in range(40)] for _ in range(4)]
    text = [r.choice("abc") for _ in range(80)]
    runs = {tuple(s[i:j]) for s in ref for i in range(len(s)) for j in range(i, len(s) + 1)}
    want = [max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in runs) for i in range(len(text))]
    assert substring.SuffixAutomaton(ref).matching_statistics(text) == want
    d = spark.createDataFrame([(1, "x y a b c d z"), (2, None)], "doc_id long, text string")
    for shard in (1, 1000):
        out = substring.cut_reference(d, spark.createDataFrame([("q a b c d",), ("c d z",), (None,)], "text string"), window=3, shard_words=shard)
        assert sorted(map(tuple, out.collect())) == [(1, 7, 5, "x y"), (2, 0, 0, "")]


def test_packing_round_trip(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["Hello, WORLD!!! it's été... (a). <|endoftext|> foo<|endoftext|>. İst ΣΣ 3.14, 5km; don't!?", "ﬁne №5 ½. 日本語。 ​. 😀.😀 .x. ..x.."]
    r = random.Random(12)
    spans = [(32, 126)] * 6 + [(9, 13), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x52F), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0xFB00, 0xFB06), (0x1F600, 0x1F64F), (0x1E00, 0x1EFF)]
    odd += ["".join(chr(r.randint(*r.choice(spans))) + r.choice(["", "", " ", "the", "ing", "ß", "İ", "'s"]) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    extra = docs.sparkSession.createDataFrame([(80 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    out = packing.pack(both, path, with_ids=True, group_windows=4).collect()
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]) for t in [t for _, t in corpus()] + odd)
    assert sum(x["length"] for x in out) == sum(map(len, want))
    assert all(x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) and len(x["ids"]) == x["length"] for x in out)
    one = [x for x in out if x["doc_id"] == 71]
    assert tuple(i for x in sorted(one, key=lambda x: x["start"]) for i in x["ids"]) == next(w for w in want if len(w) == one[0]["doc_tokens"])
    seq = {}
    for x in out:
        seq.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in seq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 4096
    assert packing.pack(empty, path).count() == 0


def test_differencing():
    assert sorted(sum(s for s in ([8, 7, 6, 5, 4][i] for i in w)) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    r = random.Random(1)
    sizes = [r.randrange(1, 900) for _ in range(500)]
    w = packing.windows(sizes, 4096)
    assert sorted(i for x in w for i in x) == list(range(500)) and max(sum(sizes[i] for i in x) for x in w) <= 4096 and len(w) <= -(-sum(sizes) // 4096) + 1


def test_decontamination(spark, empty):
    items = [(1, "A train leaves Paris at 5 km per hour and meets Anna after 12 hours near the old bridge, then Anna walks 12 km home."), (2, "short item here"), (3, None), (4, "5 6 7 8 9 10")]
    hit = items[0][1]
    new = hit.replace("Anna", "Carla").replace("12", "30").replace("Paris", "Rome")
    mixed = hit.replace("Anna", "Carla", 1).replace("12", "30", 1).replace("Paris", "Rome")
    rows = [(1, "foo bar. " + hit + " baz"), (2, new), (3, mixed), (4, "nothing to see here at all"), (5, None), (6, ""), (7, "Short item here"), (None, hit), (8, "1 2 3 4 5 6 7 8 9 10 11")]
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, item string, coverage string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (1, 10**6):
        got = {(x["doc_id"], x["item_id"], x["match"]) for x in decontam.contaminated(d, b, chunk=chunk).collect()}
        assert {(1, 1, "verbatim"), (2, 1, "template"), (7, 2, "verbatim"), (None, 1, "verbatim")} <= got
        assert not {x[0] for x in got} & {3, 4, 5, 6, 8}  # 3 fills one slot with two values
    tie = decontam.Tie()
    assert tie.add([(1, b"5", b"6")]) and not tie.add([(1, b"5", b"7")]) and not tie.add([(1, b"8", b"6")]) and tie.add([(1, b"8", b"9"), (1, b"5", b"6")])
    assert not tie.add([(3, b"x", b"y"), (3, b"x", b"z")]) and tie.slots == 3 and not tie.same
    assert decontam.contaminated(empty, b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_of_random_templates(spark):
    """Whole copies with other slot values are found if, and only if, the values correspond one to one."""
    r = random.Random(11)
    names = ["Anna", "Ben", "Carla", "Dora", "Emil", "Fritz", "Greta"]
    words = [f"{r.choice('abcdefgh')}{r.choice('xyz')}{i}w" for i in range(300)]
    items, texts, want = [], [], set()
    for i in range(12):
        shape = [r.choice(["name", "number", *["word"] * 4]) for _ in range(24)]
        pool = r.sample(words, 24)
        keys = [r.randrange(3) for _ in shape]
        fill = lambda a, b: " ".join(a[k] if s == "name" else str(b[k]) if s == "number" else w for s, k, w in zip(shape, keys, pool))
        items.append("so " + fill(r.sample(names, 3), r.sample(range(100), 3)))
        for _ in range(6):
            a, b = [r.choice(names) for _ in range(3)], [r.randrange(100, 104) for _ in range(3)]
            texts.append(f"{rng_text(r, 20)} so {fill(a, b)} {rng_text(r, 20)}")
            used = {"name": {k for s, k in zip(shape, keys) if s == "name"}, "number": {k for s, k in zip(shape, keys) if s == "number"}}
            if len({a[k] for k in used["name"]}) == len(used["name"]) and len({b[k] for k in used["number"]}) == len(used["number"]):
                want.add((len(texts) - 1, i))
        # one occurrence of a repeated value changed: no filling of the template
        k = next((k for k in range(3) if sum(s == "number" and x == k for s, x in zip(shape, keys)) > 1), None)
        if k is not None:
            at = [n for n, (s, x) in enumerate(zip(shape, keys)) if s == "number" and x == k][0]
            w = fill(["Gerd", "Hans", "Ida"], [201, 202, 203]).split()
            w[at] = "299"
            texts.append("so " + " ".join(w))
    whole = {(d, i) for d, i, _ in found(spark, items, texts)}
    # a run of 13 words whose own slots agree is a find as well, so only whole copies must be there
    assert want <= whole
    def run_agrees(d, i):
        t, it = texts[d].split(), items[i].split()
        kind = lambda x: 1 if x.isdigit() else 3 if x in names or x in ("Gerd", "Hans", "Ida") else 0
        for s in range(len(t) - 12):
            for z in range(len(it) - 12):
                pairs = list(zip(it[z : z + 13], t[s : s + 13]))
                if all(kind(x) == kind(y) and (kind(x) or x == y) for x, y in pairs):
                    slots = {(kind(x), x, y) for x, y in pairs if kind(x)}
                    if len({(k, x) for k, x, _ in slots}) == len(slots) == len({(k, y) for k, _, y in slots}):
                        return True  # at least a part agrees
        return False
    assert all((d, i) in want or run_agrees(d, i) for d, i in whole)


def found(spark, items, texts):
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(x["doc_id"], x["item_id"], x["match"]) for x in decontam.contaminated(d, b).collect()}


def test_decontamination_names_open_sentences(spark):
    items = ["Anna has 12 apples. Anna gives 5 apples to Ben. How many apples does Anna have left?", "Anna walks to the market every morning. Carl sleeps until noon on most days."]
    texts = ["Maria has 30 apples. Maria gives 7 apples to Tom. How many apples does Maria have left?", "Eve walks to the market every morning. Fred sleeps until noon on most days.", "It is said that Eve walks to the market every morning. Fred sleeps until noon on most days.", "Maria paints a wall. Tom runs home."]
    assert {(0, 0, "template"), (1, 1, "template"), (2, 1, "template")} <= (got := found(spark, items, texts)) and 3 not in {x[0] for x in got}
    assert found(spark, items, items) == {(0, 0, "verbatim"), (1, 1, "verbatim")}


def test_decontamination_of_edited_and_quoted_items(spark):
    r = random.Random(7)
    item = [f"{r.choice('abcdefgh')}{x}q" for x in r.sample(range(900), 40)]
    edit = lambda *at: " ".join("changed" if n in at else x for n, x in enumerate(item))
    pad = rng_text(r, 60)
    texts = [edit(20), edit(10, 30), edit(*range(4, 40, 5)), " ".join(item[:30]), " ".join(item[5:18]), " ".join(item[:20] + ["new"] + item[20:]), " ".join(item[:20] + item[22:])]
    clean = [" ".join(item[:12]), edit(*range(3, 40, 4)), pad, " ".join(sorted(item))]
    got = found(spark, [" ".join(item)], [f"{pad} {x} {pad}" for x in texts + clean])
    assert got == {(n, 0, "verbatim") for n in range(len(texts))}
    assert [decontam.surest(n, n // 5) for n in (5, 9, 15, 40)] == [2, 4, 3, 4]


def test_decontamination_of_items_of_placeholders(spark):
    items = ["5 6 7 8 9 10", "42", "3 km 4 km 5 km"]
    texts = ["The row is 5 6 7 8 9 10 and ends.", "4 5 6 7 8 9 10 11", "5 6 7 8 9 11", "42", "It is 42 now.", items[2], "3 km 4 km 6 km", ""]
    assert found(spark, items, texts) == {(0, 0, "verbatim"), (3, 1, "verbatim"), (5, 2, "verbatim")}


def test_decontamination_finds_every_planted_item(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    planted = {tuple(x) for x in d.join(b.withColumnRenamed("text", "t"), F.contains("text", "t")).select("doc_id", "item_id").collect()}
    assert planted <= {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(d, b).collect()}


def test_warc(spark, tmp_path):
    big = "x" * 1200 + "é"
    rows = [(1, "http://a", big), (2, None, big), (9, "http://c\r\nX: 1", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "http://f", None), (None, "http://g", big)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.archive(pages, path)
    got = {x["row_id"]: x for x in warc.read(spark, path).collect()}
    assert {k: (x["record_type"], x["refers_to"]) for k, x in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 9)}
    assert bytes(got[9]["payload"]) == big.encode() and got[1]["payload_bytes"] == len(big.encode()) and got[6]["payload_bytes"] == 0
    only = warc.read(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [x["row_id"] for x in only.collect()] == [1]
    (tmp_path / "stray.warc").write_bytes(b"")
    warc.archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_of_many_copies_and_long_payloads(spark, tmp_path):
    r = random.Random(3)
    long = "é" * 3_000_000
    body = ["a" * 999, "b" * 1000, "c" * 5000, long, "", None]
    rows = [(i, f"http://{i}", r.choice(body), "x") for i in range(300)] + [(7, "http://7", body[2], "x"), (7, "http://7", body[2], "x"), (None, None, long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row_id string").withColumnRenamed("row_id", "payload_digest")
    warc.archive(pages, f"{tmp_path}/w")
    head = {b: max(i for i, _, x, _ in rows if x == b and i is not None) for b in body if b and len(b.encode()) >= 1000}
    got = sorted(((x["row_id"] if x["row_id"] is not None else -1), x["record_type"], x["refers_to"] or -1, x["payload_bytes"], x["payload"] is None) for x in warc.read(spark, f"{tmp_path}/w").collect())
    want = sorted((-1 if i is None else i, *(("revisit", head[b]) if b in head and head[b] != i else ("response", -1)), len((b or "").encode()), b in head and head[b] != i) for i, _, b, _ in rows)
    assert got == want


def test_warc_gzip_of_others(spark, tmp_path):
    import gzip

    recs = [warc.to_record(i, "http://x", "0" * 40, 3, None, b"abc") for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    assert [(x["row_id"], bytes(x["payload"])) for x in warc.read(spark, str(tmp_path)).orderBy("row_id").collect()] == [(i, b"abc") for i in range(3)]


def test_ann(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((900, 16)) * r.uniform(0.5, 2, (900, 1))
    x[100:200] = x[100]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [None] + [1.0] * 15), (None, [1.0] * 16), (1100, [1.0] * 3), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    out = ann.nearest(df, lambda i: i % 20 == 0, k=20, block=300, query_block=20).collect()
    got = {}
    for t in sorted(out, key=lambda t: (t["query_id"], t["rank"])):
        got.setdefault(t["query_id"], []).append((t["vec_id"], t["score"]))
    assert sorted(got) == list(range(0, 900, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = ann.inner(x, x[q])
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        hits += len(set(order) & {i for i, _ in found})
        assert found == sorted(found, key=lambda t: (-t[1], t[0])) and all(v == s[i] for i, v in found)
    assert hits / (20 * len(got)) >= 0.9
    tied = [i for i, _ in got[100] if 100 <= i < 200]  # copies of the query: the smallest ids, in order
    assert tied == [*range(101, 101 + len(tied))] and len(tied) > 5
    exact = ann.nearest(df, lambda i: i % 20 == 0, k=20, block=300, query_block=20, beta=1.0).collect()
    assert sorted((t["query_id"], t["rank"], t["vec_id"]) for t in exact) == [(q, n + 1, i) for q in sorted(got) for n, i in enumerate([i for i in np.lexsort((np.arange(900), -ann.inner(x, x[q]))) if i != q][:20])]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few, lambda i: i == 0).count() == 2 and ann.nearest(few.limit(0), lambda i: i == 0).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_ann_recall_on_embeddings(spark, folder):
    e = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect() if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for t in entries.op9_ann(spark, f"/root/testdata/{folder}").collect():
        got.setdefault(t["query_id"], set()).add(t["vec_id"])
    hits = 0
    for q in got:
        s = ann.inner(x, x[ids == q][0])
        hits += len(got[q] & {ids[i] for i in [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]})
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0) and hits / (20 * len(got)) >= 0.95


def test_language_against_a_loop():
    """Scores are cosines with the nearest centroid of TF-IDF vectors, worked out gram by gram."""
    r = np.random.default_rng(8)
    texts = ["Der Hund läuft.", "the dog runs", "", "a", "été " * 50]
    counts = langid.gram_counts(plain(pa.array(texts)), langid.DIM)
    idf = r.uniform(1, 3, langid.DIM).astype(np.float32)
    c = r.uniform(0, 1, (6, langid.DIM)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    m = langid.Centroids(["aa", "bb"], c, np.array([0, 0, 0, 1, 1, 1]), np.zeros(6), idf)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(5), pa.int64()), "text": pa.array(texts)})
    out = next(iter(langid._score(m)([batch]))).to_pydict()
    for d, t in enumerate(texts):
        w = [np.log1p(float(n)) * float(i) for n, i in zip(counts[d], idf)]
        norm = sum(v * v for v in w) ** 0.5
        cos = [sum(v * float(u) for v, u in zip(w, row)) / norm if norm else 0.0 for row in c]
        if any(ch.isalpha() for ch in t):
            assert abs(out["score"][d] - max(cos)) < 1e-4 and out["lang_pred"][d] == ("aa" if int(np.argmax(cos)) < 3 else "bb")
        else:
            assert (out["lang_pred"][d], out["score"][d]) == ("und", 0.0)


def test_ftrl_against_a_loop():
    r = np.random.default_rng(3)
    rows = [(int(r.integers(2)), np.unique(r.integers(0, 16, 5)).astype("<u4")) for _ in range(40)]
    z, n, zb, nb, order = [0.0] * 16, [0.0] * 16, 0.0, 0.0, np.random.default_rng(1)
    weight = lambda z, n: 0.0 if abs(z) <= 0.5 else -(z - (0.5 if z > 0 else -0.5)) / ((1 + n**0.5) / 0.7 + 1)
    for _ in range(2):
        for i in order.permutation(40):
            y, x = rows[i]
            w, wb = [weight(z[j], n[j]) for j in x], -zb / ((1 + nb**0.5) / 0.7)
            g = (1 / (1 + np.exp(-(sum(w) + wb))) - y) * (3.0 if y else 1.0)
            for j, v in zip(x, w):
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / 0.7 * v
                n[j] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / 0.7 * wb
            nb += g * g
    got, bias = toxicity.ftrl(rows, 4, epochs=2, alpha=0.7, l1=0.5)
    assert np.allclose(got, [weight(a, b) for a, b in zip(z, n)]) and abs(bias + zb / ((1 + nb**0.5) / 0.7)) < 1e-9
    assert (got == 0).any() and (got != 0).any()


def test_tables_against_a_loop():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.boost(x, y, rounds=20, pair_rounds=10)
    p = quality.predict(x, t)
    for d in range(0, 300, 17):
        f = t.bias + sum(v[sum(x[d, j] >= e for e in edges)] for j, (edges, v) in enumerate(zip(t.edges, t.main)))
        for i, j, v in t.pairs:
            a, b = (sum(x[d, k] >= e for e in t.pair_edges[k]) for k in (i, j))
            f += v[a * (len(t.pair_edges[j]) + 1) + b]
        assert abs(p[d] - 1 / (1 + np.exp(-f))) < 1e-9
    assert ((p >= 0.5) == y).mean() > 0.8  # only the pair tables can tell


def test_repeated_labels_and_ids_are_settled_alike(spark):
    d = spark.createDataFrame([(i, "bad word" if i % 2 else "fine words") for i in range(40)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 0)], "doc_id long, toxic int")
    a, b = toxicity.fit(d, y, "toxic", l1=0.1), toxicity.fit(d, y.orderBy(F.desc("toxic"), F.desc("doc_id")), "toxic", l1=0.1)
    assert (a.w == b.w).all() and a.bias == b.bias
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [t["score"] for t in ann.nearest(v, lambda i: i == 0).collect()] == [2.0]


def test_sieve(spark):
    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("key")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("key")))
    rows = spark.range(3000).withColumn("_b", F.lit("x"))
    got = common.sifted(rows, F.xxhash64("id"), common.sieve(keys, 20), "hit", 20)
    hit = {r["id"] for r in got.where("hit").collect()}
    assert set(range(0, 3000, 7)) <= hit and len(hit) < 460 and got.columns == ["id", "_b", "hit"]
    held = common.bitmap(keys, 20)
    assert int(np.unpackbits(held).sum()) == len({r["key"] % (1 << 20) for r in keys.where("key is not null").collect()})
    assert common.sifted(rows, F.xxhash64("id"), common.sieve(keys.limit(0), 20), "hit", 20).where("hit").isEmpty()


def test_join_of_counted_keys(spark):
    rows = [(i % 3 if i < 90 else i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, v long")
    n = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for hot in (1, 10, 10_000):
        assert sorted((r["k"], r["v"], r["n"]) for r in common.join_counted(df, n, ["k"], hot=hot).collect()) == sorted((k, v, 30 if k < 3 else 1) for k, v in rows)


def test_language(spark, sf, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    h = entries.op3_language(spark, "/root/testdata/sf0.01").where("held_out").join(d.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert h.where("lang = lang_pred").count() / h.count() > 0.97
    m = langid.fit(docs.where("doc_id < 50"))
    got = {x["doc_id"]: x for x in langid.identify(docs, m).collect()}
    assert got[60]["lang_pred"] == got[61]["lang_pred"] == got[62]["lang_pred"] == "und" and got[71]["lang_pred"] == "en"
    none = langid.fit(empty)
    assert {x["lang_pred"] for x in langid.identify(docs, none).collect()} == {"und"} and langid.identify(empty, m).count() == 0


def held_out(spark, f, label):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col(label).alias("y"))
    h = f(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    return (h.y == h.predicted).mean(), h.score[h.y == 1].median() - h.score[h.y == 0].median()


def test_toxicity(spark, docs, empty):
    right, gap = held_out(spark, entries.op1_toxicity, "toxic")
    assert right > 0.95 and gap > 0.5
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, toxic int")
    toxic = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit(" idiot"))).otherwise(F.col("text")))
    m = toxicity.fit(toxic, labels, "toxic", l1=1.0)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(toxic, m).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(40)) and 0 <= got[60] <= 1 and got[60] == got[62]  # no text, no words
    assert toxicity.keep(toxic, m, 0.5).columns == toxic.columns
    assert toxicity.score(empty, m).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), "toxic")).agg(F.max("score")).first()[0] < 0.5


def test_quality(spark, docs, empty):
    right, gap = held_out(spark, entries.op5_quality, "quality")
    assert right > 0.95 and gap > 0.5
    x = quality.measure(plain(pa.array(["a a a\na a a\n", None, "", "ÉT !! | 12"])))
    assert x.shape == (4, len(quality.NAMES)) and np.isfinite(x).all()
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    m = quality.fit(docs, labels, "quality", rounds=5, pair_rounds=2)
    assert quality.score(docs, m).where("score between 0 and 1").count() == docs.count() and quality.score(empty, m).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.where("quality = 1"), "quality")).agg(F.min("score")).first()[0] > 0.7


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_matches_sql(spark, sf, duck, same, name):
    same(entries.QUERIES[name](spark, sf), duck, entries.ORACLES[name])


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    import corpus_pipeline as p

    long = rng_text(random.Random(9), 40_000)
    rows = [(1, "some words of a text that nobody else has", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, long, None, "s", 9), (3, long, None, "s", 9), (4, long + " end", "en", "s", 9), (None, "a lone text without an id of its own", "en", "s", 1), (5, " \n\t\n", "de", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for extra in ([], ["_gone", "_id", "fp", "kept", "_hit", "_again", "id", "n_removed"]):
        docs = spark.createDataFrame(rows, schema)
        for c in extra:
            docs = docs.withColumn(c, F.lit("x"))
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert set(out.columns) == set(docs.columns) and stage(spark, docs.limit(0), sf).count() == 0, name
            ids = sorted((x["doc_id"] or 0) for x in out.collect())
            assert ids == ([0, 0, 1, 2, 3, 5] if name == "near-dedup" else [0, 0, 1, 2, 3, 3, 4, 5]), name
    packed = p.to_sequences(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert sum(x["start"] == 0 for x in packed) == len(rows) and p.to_sequences(spark, spark.createDataFrame([], schema), sf).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {0: docs}
    for n, (_, stage) in enumerate(p.STAGES[:-1], 1):
        rows[n] = stage(spark, rows[n - 1], sf).cache()
        assert rows[n].columns == docs.columns and 0.5 * rows[n - 1].count() < rows[n].count() <= rows[n - 1].count()
    assert rows[2].count() == rows[1].count() and rows[2].where("n_chars <> length(text)").isEmpty()
    near = minhash.near_duplicates(rows[3], k=5, percent=80)
    assert near.where("not kept").isEmpty()
    assert decontam.contaminated(rows[4], spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
    out = p.run(spark, sf)
    assert out.select("doc_id").distinct().count() == rows[4].count()
    assert out.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n <> doc_tokens").isEmpty()


def test_a_packing_worker_holds_little():
    """Over 4 MB of texts full of different words: memory beyond the start, at most and when the task has ended."""
    code = """
import re, threading, time
import numpy as np, pyarrow as pa, public_tokenizers
import pyspark.worker
from eqloom.llm import packing
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
path = public_tokenizers.path("word_bpe_49k.json")
packing._encoder(path)
rng = np.random.default_rng(1)
texts = [" ".join(f"w{x}-{x % 7}" for x in rng.integers(0, 60_000, 250)) for _ in range(2000)]
b = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["id", "text"])
del texts
start, most, on = held(), [0.0], [True]
def watch():
    while on[0]:
        most[0] = max(most[0], held())
        time.sleep(0.005)
w = threading.Thread(target=watch)
w.start()
rows = sum(o.num_rows for o in packing._pieces(path, 4096, 1024, 2, True)(iter([b])))
end, on[0] = held(), False
w.join()
print(rows, most[0] - start, end - start)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120)
    rows, most, end = map(float, out.stdout.split())
    print(out.stdout)
    assert rows >= 2000 and most < 90 and end < 45
