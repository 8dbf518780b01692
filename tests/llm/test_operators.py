"""Training-data operators against SQL, brute force, exact round trips and held-out accuracy; odd inputs for each."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import charlm, chat, decontaminate, gbt, htmltext, langid, linededup, neardup, pieces, pii, quality, queries, simhash
from loomgraph.llm.common import SIEVE, Scratch, sieve, sieved

from ..oracle import same

LOWER = {c: c + 32 for c in range(65, 91)}
#: nulls in every column, empty and long texts, ties, repeated rows, extra columns
ODD = [(1, None, None, "x"), (2, "", "en", "x"), (3, "a " * 30000, "en", None), (4, "same text here now", "en", "x"), (5, "same text here now", "en", "x"), (6, "same text here now", "fr", "x"), (6, "same text here now", "fr", "x"), (None, "no id", None, None), (7, "a" * 50000, None, "x"), (8, "\n\n", "en", "x"), (9, "\U0001f600 é", "en", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, score2 string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], small)


def scratch(spark):
    return Scratch(spark, "test")


def test_saving_hands_freed_native_memory_of_the_driver_back(spark):
    native, pid = spark._jvm.org.apache.spark.unsafe.Platform, spark._jvm.java.lang.ProcessHandle.current().pid()

    def mb():
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    scratch(spark).save(spark.range(3)).count()  # loads what saving needs
    blocks = [native.allocateMemory(100_000) for _ in range(1500)]
    for at in blocks:
        native.copyMemory(None, blocks[0], None, at, 100_000)
    for at in blocks[:-1]:  # the last keeps the pool from shrinking by itself
        native.freeMemory(at)
    spark._jvm.System.gc()
    before, Scratch.swept = mb(), float("-inf")
    assert scratch(spark).save(spark.range(3)).count() == 3
    after = mb()
    native.freeMemory(blocks[-1])
    assert before - after > 80


# -- 1 ---------------------------------------------------------------------------------------------------------------------


def test_html_text(spark, small):
    rows = htmltext.op1_html_text(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect()
    import html

    for r in rows:
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


def test_html_text_leaves_the_rest_out():
    page = "<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'><p>We use cookies, accept all of them.</p></div><main><article><h1>Title of it</h1>" + "<p>A long first paragraph, with commas, that says a lot of things.</p>" * 3 + "<script>x='<p>no</p>'</script></article></main><aside class=sidebar><h3>Related</h3><p>Some other story here.</p></aside><section class=comments><p>First! I like it, really.</p></section><form><label>Search</label></form><footer>&copy; us</footer></body></html>"
    got = htmltext.texts_of([page, None, "", "<p", "plain"], htmltext.forest())
    assert got[0].split("\n") == ["Title of it"] + ["A long first paragraph, with commas, that says a lot of things."] * 3
    assert got[1] == got[2] == ""


def test_html_quotes_hidden_text_and_attributes():
    long = "A long paragraph, with commas, that says a lot of things about it."
    page = f"<body><nav class=menu><a href=/>Home</a></nav><article><h1>Title of it</h1><p title='it's fine'>{long}</p><p title='it's'>Hello there, {long}<p data-id=sidebar data-class='ad'>{long}</p><p title=\"odd>{long}</p><p class=\"x\">{long} <b a='>'>bold</b></p><p hidden>unseen words</p><div style='display: none'><p>unseen too</p></div><p class=hidden-gem>{long}</p></article>"
    got = htmltext.texts_of([page], htmltext.forest())[0].split("\n")
    assert got == ["Title of it", long, f"Hello there, {long}", long, long, f"{long} bold", long]
    assert htmltext.attributes(" data-id=x class='a b' id=\"c\" hidden=''") == ("a b c", True)


@pytest.mark.parametrize("piece", ["<b></i>", "<a ", "<b>", "<blockquote>", "<p><b>", "<i><div><b></i>", "<thead><blockquote>", "<li><dt>", "</p>", "<a href=\"", "<a b='c", "<!--", "<td><p>", "&amp", "<title>"])
def test_broken_markup_is_read_in_linear_time(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        htmltext.Page(piece * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_html_odd(spark):
    page = "<article><h1>Title here</h1><p>Some words, and more words, that make up a paragraph.</p></article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", page), (3, "u", page), (None, None, page), (4, "u", "<p>" + "x " * 500_000), (5, "u", "plain text, no tags at all")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit(1))
    got = htmltext.extract(pages)
    assert got.columns == [*pages.columns, "text"]
    texts = [r["text"] for r in got.orderBy("page_id").collect()]
    assert len(texts) == len(rows) and sum(t.startswith("Title here\nSome words") for t in texts) == 3 and sum(t == "" for t in texts) >= 2
    assert htmltext.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already in use"):
        htmltext.extract(pages.withColumn("text", F.lit(1)))


def test_forest_learns_and_prints_as_sql():
    import numpy as np

    x = np.random.default_rng(0).random((400, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = gbt.fit(x, y, trees=30, depth=3)
    assert ((f.predict(x) > 0.5) == y).mean() > 0.97
    assert f.sql(["a", "b"]).count("if(") > 30


# -- 2 ---------------------------------------------------------------------------------------------------------------------


def test_simhash_against_brute_force(spark, small):
    got = {r["doc_id"]: r for r in simhash.op2_simhash(spark, small).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = simhash.Fingerprinter()
    fp = [prints(t) for _, t in docs]
    for i, (d, t) in enumerate(docs):
        e = simhash.edit(t, docs[(i + 1) % len(docs)][1])
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == f"{fp[i]:016x}" and r["edited_fingerprint"] == f"{prints(e):016x}"
        assert r["near_next"] == simhash.likeness(fp[i], fp[(i + 1) % len(docs)])
        if d % 50 == 0:
            assert r["n_within"] == sum((fp[i] ^ f).bit_count() <= simhash.RADIUS for f in fp) - 1
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.95 * len(got)


def test_votes_against_loops():
    import math

    import numpy as np
    import xxhash
    from loomgraph.llm.common import mix64

    def mix(x):
        return int(mix64(np.array([x], np.uint64))[0])

    rnd = random.Random(12)
    for _ in range(60):
        text = " ".join(rnd.choice(["A", "b", "cc", "é"]) for _ in range(rnd.randint(0, 30)))
        words = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
        terms = [mix(mix(a) ^ b) for a, b in zip(words, words[1:])] if len(words) > 1 else [mix(w) for w in words]
        votes = [sum((1 if t >> bit & 1 else -1) * round(1024 * (1 + math.log(terms.count(t)))) for t in set(terms)) for bit in range(64)]
        assert simhash.Fingerprinter()(text) == sum((v > 0) << bit for bit, v in enumerate(votes))


def test_simhash_odd(spark, odd, none):
    got = simhash.fingerprints(odd, scratch(spark)).collect()
    assert len(got) == len(ODD)
    assert len({r["fp"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert simhash.fingerprints(none, scratch(spark)).count() == 0


def test_block_tables_find_all_within_radius(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(5)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(40)]
    q, e = [simhash.signed(b) for b in base], sorted({simhash.signed(x) for x in near})
    got = {tuple(r) for r in simhash.within(spark.createDataFrame([(x,) for x in q], "q long"), spark.createDataFrame([(x,) for x in e], "fp long")).collect()}
    assert got == {(a, b) for a in q for b in e if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.RADIUS}


# -- 3 ---------------------------------------------------------------------------------------------------------------------


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "x"), (6, None, None, "z"), (6, None, None, "z"), (7, 300, "user", "late"), (7, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    got = {(r["conv_id"], r["block"]): r for r in chat.render(df, scratch(spark)).collect()}
    assert {k[0] for k in got} == {1, 4, 5, 6, 7, None} and got[(1, 0)]["copies"] == 2
    assert got[(1, 0)]["rendered"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n" and got[(6, -1)]["n_turns"] == 1
    assert {b for c, b in got if c == 7} == {0, 1}
    assert chat.render(df.limit(0), scratch(spark)).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------------


def test_line_templates(spark):
    line = "the server {} answered with code {} after some time today"
    rows = [(i, f"own words of document {chr(97 + i)} " * (i + 3) + "\n" + line.format("abc" if i else "x", i) + "\nshort one") for i in range(5)]
    got = {r["doc_id"]: r for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_dropped"] == 2 and got[i]["clean_text"] == rows[i][1].split("\n")[0] for i in range(1, 5))


def test_line_templates_general_part_and_copies(spark):
    words = [f"w{chr(97 + k)}" for k in range(14)]
    varied = [" ".join([*words[:5], *v, *words[7:]]) for v in (("x", "y"), ("p", "q"), ("r", "s"))]
    other = ["alpha beta " * 20, "gamma delta " * 20, "epsilon zeta " * 20]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.clean(spark.createDataFrame([(i, f"{o}\n{v}") for i, (o, v) in enumerate(zip(other, varied))], "doc_id long, text string"), scratch(spark)).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
    copies = spark.createDataFrame([(i, "one two three four five six seven\neight nine ten eleven twelve thirteen") for i in range(4)], "doc_id long, text string")
    assert {r["n_dropped"] for r in linededup.clean(copies, scratch(spark)).collect()} == {0}


def test_names_in_lines_are_wildcards(spark):
    lines = ["user alice logged in from host paris at the main gate today ok", "user bob logged in from host paris at the main gate today ok", "user bob logged in from host rome at the main gate today ok"]
    own = ["first own text of it", "second thing that stands alone", "third and last of these"]
    docs = spark.createDataFrame([(i, f"{o}\n{x}") for i, (o, x) in enumerate(zip(own, lines))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.clean(docs, scratch(spark)).collect()} == {0: 0, 1: 1, 2: 1}
    found = {r["template"]: r for r in linededup.templates(docs, scratch(spark)).collect()}
    top = found["user <*> logged in from host <*> at the main gate today ok"]
    assert top["n_texts"] == 3 and top["first"] == 0 and top["n_tokens"] == 13


def test_boilerplate_pages_and_texts_that_share_an_id(spark):
    line = "the same old footer line stands on every page of it"
    rows = [(1, line), (2, f"{line}\n{line}"), (3, f"own words here\n{line}"), (9, f"unique words at nine\n{line}"), (9, "something else\nonly here and nowhere else at all"), (None, "no id\nat all"), (None, "no id\nat all")]
    got = sorted((r["doc_id"] or 0, r["clean_text"], r["n_dropped"]) for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)).collect())
    assert got == [(0, "no id\nat all", 0)] * 2 + [(1, line, 0), (2, "", 2), (3, "own words here", 1), (9, "something else\nonly here and nowhere else at all", 0), (9, "unique words at nine", 1)]


def test_line_dedup_of_short_lines(spark):
    rows = [(i, f"own words of document {chr(97 + i)} " * 5 + "\nAll rights reserved.\n\nonly here " + chr(97 + i)) for i in range(4)]
    got = {r["doc_id"]: r["text"].split("\n")[1:] for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)).collect()}
    assert got == {i: ["All rights reserved."] * (i == 0) + ["", "only here " + chr(97 + i)] for i in range(4)}


def test_line_dedup_of_mosaics_and_copies(spark):
    words = lambda seed, n: " ".join(random.Random(seed).choices([a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"], k=n))
    lines = [words(k, 60) for k in range(9)]
    note = "released under the same old terms as before"
    rows = {0: ["first " * 9, note], 1: [*lines[:4], note], 2: lines[4:7], 3: [lines[0], lines[4], "some own words"], 4: [*lines[:4], note, "a few words more"], 5: ["another " * 9, note]}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in linededup.drop_lines(docs, scratch(spark)).collect()}
    # 3 is put together from 1 and 2; 4 is a copy of 1, and both lose the line that is first in 0
    assert got == rows | {1: lines[:4], 3: ["some own words"], 4: [*lines[:4], "a few words more"], 5: rows[5][:1]}


def test_line_dedup_of_passages_within_lines(spark):
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choices("bcdfghklmnprstvw", k=6)) for _ in range(n))
    passage, under = words(50), words(49)
    rows = {0: f"{words(70)} {passage} {words(9)}", 1: words(80), 2: f"{(a := words(3))} {passage} {(b := words(90))}", 3: f"{(c := words(60))} {under} {(e := words(60))}", 4: f"{words(61)} {under} {words(60)}"}
    rows[5] = rows[1].replace(rows[1].split()[55], "other")  # a near-duplicate is left whole for near-dedup
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs, scratch(spark)).collect()}
    assert got == rows | {2: f"{a} {b}"}


def test_salted_tables_are_not_broadcast(spark):
    rows = [(c, c, 0, h, True, 2, 60, 60) for c in range(40) for h in range(c, c + 3)]
    keys = spark.createDataFrame(rows, "cls long, id long, place int, h long, fresh boolean, least tinyint, n int, total long")
    hits = linededup.shared(keys, keys.where("fresh"), scratch(spark))
    assert {(r["cls"], r["h"], r["first"]) for r in hits.collect()} == {(c, h, max(0, h - 2)) for c, _, _, h, *_ in rows if 1 <= h <= 40}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("== Initial Plan ==")[0] and "lg_salt" not in " ".join(x for x in plan.splitlines() if "BroadcastHashJoin" in x)


def test_sieves_hold_their_keys_in_few_rows(spark):
    keys = spark.range(200_000).select((F.col("id") * 3).alias("k"))
    bits = sieve(keys, "k")
    assert bits.count() <= 1 << (SIEVE - 10)
    n = sieved(spark.range(60_000).withColumnRenamed("id", "k"), bits, "k").groupBy().agg(F.sum(F.expr("int(lg_may and k % 3 = 0)")), F.sum(F.expr("int(lg_may and k % 3 != 0)"))).first()
    assert n[0] == 20_000 and n[1] < 1000


def test_line_templates_odd(spark, odd, none):
    got = linededup.drop_lines(odd, scratch(spark))
    assert got.columns == odd.columns and got.count() == len(ODD)
    assert got.where("doc_id = 1").first()["text"] is None
    assert linededup.drop_lines(none, scratch(spark)).count() == 0
    assert linededup.clean(odd, scratch(spark)).where("text = clean_text").count() == len(ODD) - 1
    assert linededup.templates(none, scratch(spark)).count() == 0
    with pytest.raises(ValueError, match="already in use"):
        linededup.drop_lines(odd.withColumn("lg_may", F.lit(1)), scratch(spark))


# -- 5 ---------------------------------------------------------------------------------------------------------------------


def brute_components(rows, words, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit, elements", [(512, 10**7), (12, 10**7), (512, 500)])
def test_near_duplicates_in_large_families(spark, limit, elements, monkeypatch):
    monkeypatch.setattr(neardup, "ELEMENTS", elements)
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(2000)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows = [(i, " ".join(rnd.choice(vocab) if rnd.random() < rate else w for w in base)) for i, rate in enumerate([0, 0.005, 0.01, 0.02, 0.03, 0.05] * 12)]
    rows += [(500, ""), (501, None), (502, "one two"), (503, "One  TWO"), (504, "a b c")]
    want = brute_components(rows, 3, 85)
    got = neardup.group(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark), 3, 85, limit=limit)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_near_duplicates_of_texts_that_share_an_id_or_have_none(spark):
    words = lambda seed: " ".join(f"w{random.Random(seed * 100 + k).randint(0, 10**6)}" for k in range(40))
    a, b, c, d = map(words, range(4))
    rows = [(6, a), (6, b), (7, a + " z"), (8, b + " z"), (None, c), (None, c + " z"), (9, c + " y"), (None, d), (10, d.replace("w", "v"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.group(df, scratch(spark), 3, 85).collect())
    assert got == [(0, 0), (0, 9), (0, 9), (6, 6), (6, 6), (7, 6), (8, 6), (9, 9), (10, 10)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.keep_first(df, scratch(spark), 3, 85).collect())
    assert kept == sorted([(0, d), (6, a), (6, b), (9, c + " y"), (10, d.replace("w", "v"))])


def test_near_duplicates_odd(spark, odd, none):
    got = neardup.keep_first(odd, scratch(spark))
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert neardup.group(none, scratch(spark)).count() == 0


def test_super_minhash_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(0)
    est = []
    for _ in range(60):
        u = rng.integers(0, 2**63, 60, dtype=np.uint64)
        s = neardup.super_minhash(np.concatenate([np.unique(u[:45]), np.unique(u[15:])]), np.array([45, 45]))
        est.append((s[0] == s[1]).mean())
    assert abs(np.mean(est) - 0.5) < 0.02 and np.var(est) < 0.25 / neardup.SLOTS


# -- 6 ---------------------------------------------------------------------------------------------------------------------


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) for i, c in enumerate(s[::-1])) % 10 == 0


def brute_pii(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(q) > 255 for q in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_against_brute_force(spark):
    rnd = random.Random(5)
    bits = ["1", "2", "a", ".", "..", "@", "-", " ", "+", "(", "4111111111111111", "555", "x@y.z", "%", "_", "1.2.3.4", "é", "\U0001f600", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 100000, "1 " * 20000, "a@" + "b." * 10000 + "c", "", None, "0001.2.3.4", "1.2.3.4.5.6.7.8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit(1))
    got = pii.find(df).select("doc_id", F.expr(pii.joined("pii.base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in got} == {i: brute_pii(t or "") for i, t in enumerate(texts)}


def test_pii_selects_greedily_best_first(spark):
    rnd = random.Random(11)
    rows = [[(rnd.choice("ab"), s := rnd.randint(0, 60), s + rnd.randint(1, 12), float(rnd.randint(0, 5))) for _ in range(n)] for n in [0, 1, 2, 5, 20, 90, 300] * 6]

    def best(spans):
        out = []
        for kind, s, e, m in sorted(set(spans), key=lambda c: (-c[3], c[1], c[2], c[0])):
            if not any(d[1] < e and s < d[2] for d in out):
                out.append((kind, s, e, m))
        return {c[:3] for c in out}

    df = spark.createDataFrame([(i, list(set(r))) for i, r in enumerate(rows)], f"doc_id long, c {pii.SPANS}")
    got = df.select("doc_id", F.expr(pii.greedy("c")).alias("g")).collect()
    assert {r["doc_id"]: {tuple(c)[:3] for c in r["g"]} for r in got} == {i: best(r) for i, r in enumerate(rows)}


def test_pii_of_many_matches_and_odd_tables(spark, odd, none):
    import time

    ips = lambda n: " ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(n))
    texts = [ips(20_000), " ".join(f"tel 555-{i:04d}-{i:04d}," for i in range(2_000)), "key=" + "a1B2c3D4e5F6g7H8 " * 1_000]
    began = time.time()
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "pii.n_ip", "pii.n_added", F.expr(pii.joined("pii.base")).alias("b")).orderBy("doc_id").collect()
    assert time.time() - began < 90 and got[0]["n_ip"] == 20_000 and [r["b"] for r in got] == [brute_pii(t) for t in texts]
    assert got[1]["n_added"] > 1_800
    assert pii.find(none).count() == 0 and pii.redact(odd).columns == odd.columns
    assert pii.find(odd).count() == len(ODD)
    with pytest.raises(ValueError, match="already in use"):
        pii.find(odd.withColumn("lg_base", F.lit(1)))


def test_pii_further_kinds_and_redaction(spark):
    rows = [(1, 'the token = "f33e61083db5dbdf4bd2369d2f80176e57f7aabb" ok'), (2, "mail a.b@c.de now"), (3, None), (4, "plain text only")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 'the token = "<secret>" ok', 2: "mail <email> now", 3: None, 4: "plain text only"}
    x, y = pii.examples(seed=21, count=800)
    forest, least = pii.model()
    chosen = forest.margin(x) >= least
    assert y[chosen].mean() > 0.9 and chosen[y > 0].mean() > 0.5


# -- 7, 8 ------------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(words, order):
    """p(history, character) of an interpolated modified Kneser-Ney model, by plain dictionaries."""
    from collections import Counter, defaultdict

    top = Counter()
    for w in words:
        w = charlm.START + w + charlm.END
        for i in range(1, len(w)):
            top[w[max(0, i - order + 1) : i + 1]] += 1
    level = {order: {g: n for g, n in top.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in level[k + 1]:
            before[g[1:]].add(g[0])
        level[k] = {g: len(v) for g, v in before.items()} | {g: n for g, n in top.items() if len(g) == k and g[0] == charlm.START}
    cuts = {}
    for k, grams in level.items():
        n = [sum(v == i for v in grams.values()) for i in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        cuts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / max(n[i], 1), 0.1), i - 0.1) for i in (1, 2, 3)]
    size = len(level[1])

    def p(history, c):
        if not history:
            rest = {g: v for g, v in level[1].items()}
            low = 1 / (size + 1)
        else:
            rest = {g: v for g, v in level[len(history) + 1].items() if g[:-1] == history}
            low = p(history[1:], c)
        if not rest:
            return low
        d, total = cuts[len(history) + 1], sum(rest.values())
        n = rest.get(history + c, 0)
        return (n - d[min(n, 3)]) / total + sum(d[min(v, 3)] for v in rest.values()) / total * low

    return p, [g for g in level[1]]


def test_kneser_ney_against_dictionaries_and_sums_to_one(spark):
    import numpy as np

    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcd", weights=[5, 3, 2, 1], k=rnd.randint(1, 6))) for _ in range(150)]
    p, alphabet = brute_kneser_ney(words, 4)
    for history in ("", "\x02", "\x02a", "ab", "abc", "dd", "zz", "\x02ab"):
        assert abs(sum(p(history, c) for c in [*alphabet, "?"]) - 1) < 1e-9
    tables = charlm.train(spark.createDataFrame([("m", " ".join(words[:90])), ("m", "  ".join(words[90:])), (None, "xyz"), ("m", None)], "model string, text string"), scratch(spark), 4, "letters")
    model = tables.collect()
    probe = [*words[:20], "dcba", "aaaaaaaa", "z", "abz", "za"]
    want = []
    for w in probe:
        full = "\x02" + w + "\x03"
        want.append(sum(np.log(p(full[max(0, i - 3) : i], full[i])) for i in range(1, len(full))))
    got = charlm.sums(probe, "letters", 4, 1, model.of)
    assert np.allclose(got[:, 0], want, rtol=1e-5) and got[:, 1].tolist() == [len(w) + 1 for w in probe]
    joined = tables.joined_sums(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert np.allclose([r["lg_sums"][0] for r in joined], want, rtol=1e-9)


def test_grams_do_not_depend_on_how_texts_are_cut(monkeypatch):
    import numpy as np

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["no", "no", "a", "xy\u0301z", "\U0001f600", "w" * 30]) for _ in range(rnd.randint(0, 80))) for _ in range(30)] + [None, "", "x" * 500, "no " * 300]
    for kind in ("spaces", "letters"):
        value = lambda g: [(g.hashes % np.uint64(1009)).astype(float)]
        want = charlm.sums(texts, kind, 5, 1, value)
        monkeypatch.setattr(charlm, "CHUNK", 40)
        assert (charlm.sums(texts, kind, 5, 1, value) == want).all()
        assert (np.concatenate([charlm.sums([t], kind, 5, 1, value) for t in texts]) == want).all()
        monkeypatch.undo()
        repeats = sum(len(re.findall(r"\S+", t or "")) for t in texts)
        assert kind == "letters" or want[:, 1].sum() < sum(len(w) + 1 for t in texts for w in (t or "").split()) and repeats
    g = charlm.grams_of(["ab ab", "c"], "spaces", 3)
    assert g.strings(np.arange(len(g.hashes)), 3).tolist() == ["\x02a", "\x02ab", "ab\x03", "\x02\x04", "\x02\x04\x03", "\x02c", "\x02c\x03"]
    assert (charlm.hash_strings(g.strings(np.arange(len(g.hashes)), 3)) == g.hashes).all()


def test_languages_by_joins_and_by_arrays_alike(spark, odd, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    ordered = lambda df: [tuple(pytest.approx(v, rel=1e-4) if isinstance(v, float) else v for v in r) for r in df.orderBy("doc_id", "lang_pred", "cross_entropy").collect()]
    want = ordered(langid.identify(docs, scratch(spark)))
    monkeypatch.setattr(langid, "MAX_ENTRIES", 100)
    monkeypatch.setattr(charlm, "BLOCK_CHARS", 50_000)
    assert ordered(langid.identify(docs, scratch(spark))) == want


def test_distinct_and_index():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 40_000):
        h = rng.choice(rng.integers(0, 2**63, max(n // 3, 1), dtype=np.uint64) * np.uint64(2), n)
        u, at, count = charlm.distinct(h)
        want = np.unique(h, return_counts=True)
        assert (u == want[0]).all() and (count == want[1]).all() and (h[at] == u).all()
        if n:
            keys = rng.permutation(u)
            assert (keys[charlm.Index(keys).find(h)] == h).all()


def test_letters_that_are_none(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["plain words of text here", "½ ² ①", "\u0301\u0301", "1 2", "und x"] * 3)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, scratch(spark)).collect()}
    assert [got[i] for i in range(5)] == ["en", "und", "und", "und", "en"]


def test_quality_of_documents_whose_labels_were_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, known, scratch(spark)).join(held, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("double")).alias("kept")).collect()
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in got}
    assert kept[1, 0] >= 0.97 and kept[0, 0] <= 0.1


def test_quality(spark, small):
    got = quality.op7_quality_classifier(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    good, bad = got.where("quality = 1 and toxic = 0"), got.where("quality = 0")
    assert good.where("keep").count() >= 0.97 * good.count() and bad.where("not keep").count() >= 0.9 * bad.count()


def test_quality_of_toxic_documents(spark, monkeypatch):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abdeghilmnorstu", k=rnd.randint(2, 8))) for _ in range(400)]
    rows = [(i, " ".join([*rnd.choices(vocab, k=80), *["Blorf,", "zanktu"][i % 2 : i % 2 + (i >= 80)], *rnd.choices(vocab, k=80)]), "en") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i >= 80)) for i in range(100) if i not in range(60, 80)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # 60 to 79 and 100 to 119 have no label; one word in 160 is toxic from 80 on
    assert {r["doc_id"] for r in quality.classify(docs, labels, scratch(spark)).where("keep").collect()} == set(range(80))
    monkeypatch.setattr(charlm, "FEW_WORDS", 0)
    assert {r["doc_id"] for r in quality.keep_good(docs, labels, scratch(spark)).collect()} == set(range(80))


def test_characters_of_many_texts_are_handled_in_little_memory():
    import tracemalloc

    texts = [" ".join(f"w{i * j % 997}x" for j in range(400)) for i in range(1000)]
    charlm.word_characters("spaces"), charlm.mixed_codes()
    tracemalloc.start()
    charlm.sums(texts, "spaces", 5, 1, lambda g: g.hashes.astype(float)[None])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def peak_memory(run) -> tuple[object, float]:
    """What run gives, and the MB that it took at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tallies_are_sent_in_parts_and_held_in_little_memory():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["m"] * 50), pa.array(texts[i : i + 50])], ["model", "text"]) for i in range(0, len(texts), 50)]
    charlm.mixed_codes(), charlm.word_characters("spaces")
    sizes, mb = peak_memory(lambda: [len(n) for _, _, n in charlm.tallies(iter(batches), 5, "spaces")])
    assert sum(sizes) >= 790_000 and max(sizes) <= 100_000
    assert mb < 110


def test_lines_of_many_texts_are_hashed_in_little_memory():
    rng = random.Random(4)
    texts = [b"\n".join(b" ".join(b"w%d" % rng.randrange(10**6) for _ in range(12)) for _ in range(40)) for _ in range(1000)]
    whole = [x for lines in linededup.pieces_of(texts) for x in zip(lines.text.tolist(), lines.place.tolist(), lines.n.tolist())]
    assert whole == [(i, j, 12) for i in range(1000) for j in range(40)]
    linededup.powers(10)
    assert peak_memory(lambda: [lines.leaves()[2][:1] for lines in linededup.pieces_of(texts)])[1] < 60


def test_powers_are_computed_once_and_of_any_number():
    few, many = linededup.powers(10), linededup.powers(3 * linededup.CHUNK)
    assert few[0].base is linededup.powers(20)[0].base is not None
    assert len(few[0]) == 11 and len(many[0]) == 3 * linededup.CHUNK + 1
    assert all((a == b[:11]).all() for a, b in zip(few, many))


def test_words_of_with_a_sieve_leaves_the_others_in_the_worker(spark):
    from pyspark.sql import Row

    docs = spark.createDataFrame([(i, f"bad thing{i} Other{i} bad") for i in range(200)], "doc_id long, text string")
    bits = spark.sparkContext.broadcast(charlm.sieve_array(spark.createDataFrame([("bad",)], "word string"), scratch(spark)))
    some = quality.words_of(docs, bits).collect()
    assert {Row(doc_id=i, word="bad") for i in range(200)} <= set(some) and len(some) < 210


@pytest.mark.parametrize("kind", ["spaces", "letters"])
def test_grams_of_odd_spaces_marks_and_repeats(kind):
    texts = ["", "a a  a b\x00b b\x05", "\x1c\x1dab ab\u3000ab\n\n ab", "\x00", "\u00e9 \u00e9", "\u00e9"]
    got = charlm.grams_of(texts, kind, 3)
    lower, marks = (str.lower, "[^\\W\\d_]+") if kind == "letters" else (str, r"[^\s\x00-\x08]+")
    want = []
    for i, text in enumerate(texts):
        words = re.findall(marks, lower(text))
        words = [charlm.REPEAT if kind == "spaces" and k and w == words[k - 1] else w for k, w in enumerate(words)]
        for w in words:
            w = charlm.START + w + charlm.END
            want += [(i, w[max(0, k - 2) : k + 1]) for k in range(1, len(w))]
    import numpy as np

    assert list(zip(got.owner.tolist(), got.strings(np.arange(len(got.hashes)), 3).tolist())) == want
    assert (got.hashes == charlm.hash_strings(got.strings(np.arange(len(want)), 3))).all()


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.keep_good(odd, labels, scratch(spark))
    assert got.columns == odd.columns and got.where("doc_id in (1, 2)").count() == 2
    assert quality.classify(none, labels, scratch(spark)).count() == 0
    assert quality.classify(odd, labels.limit(0), scratch(spark)).where("keep").count() == len(ODD)


def test_language(spark, small):
    got = langid.op8_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_odd(spark, odd, none):
    got = {r["doc_id"]: r for r in langid.identify(odd, scratch(spark)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[1]["score"] == 0 and got[4]["lang_pred"] in ("en", "fr")
    assert langid.identify(none, scratch(spark)).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 10**6])
def test_wu_manber_against_brute_force(spark, block):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Aa", "b", "é1", "c", "d0"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 12, 13, 16])))) for k in range(12)] + [(99, None)]
    docs = [(i, ", ".join(word() for _ in range(rnd.randint(0, 25))) + ". " + (rnd.choice(items)[1] or "") + " z") for i in range(60)] + [(60, None)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = {}
    for i, t in docs:
        w, hits, found = words(t), set(), set()
        for k, text in items:
            p = words(text)
            m = min(13, len(p))
            for a in range(len(p) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == p[a : a + m]:
                        hits.update(range(b, b + m))
                        found.add(k)
        want[i] = (len(w), len(hits), decontaminate.digest(found))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit(1))
    got = decontaminate.mark(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert {r["doc_id"]: (r["n_words"], len(r["hit_words"]), decontaminate.digest(r["hit_items"])) for r in got.collect()} == want


def test_decontaminate_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "same text"), (None, None)], "item_id long, text string")
    got = decontaminate.drop_contaminated(odd, items)
    assert got.columns == odd.columns and got.count() == len(ODD) - 4
    assert decontaminate.drop_contaminated(none, items.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(*pieces.load())


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "Hello world\n\tx", "▁ ▁▁a", "", "日本 \U0001f600 é\x00", "x" * 3000, " " * 500, "▁ a"])
def test_pieces_round_trip(codec, text):
    assert codec.decode(codec.encode(text)) == text


def test_ids_are_those_of_the_model(spark, small, codec):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.op10_pieces(spark, small).collect()}
    assert got == dict(zip(rows, model.encode(list(rows.values()))))
    rnd = random.Random(6)
    for _ in range(400):
        text = "".join(rnd.choice(["th", "e", "in", " ", "  ", "aso", "é", "中", "\n", "7", "ABC", "\U0001f600"]) for _ in range(rnd.randint(0, 60)))
        assert codec.encode(text) == codec.whole(text) == model.encode(text)


@pytest.mark.parametrize("text", ["ab cd " * 180_000, "x" * 1_100_000, " " * 1_050_000, "日" * 400_000])
def test_a_megabyte_in_one_search(codec, text):
    import sentencepiece

    got, most, n = [], 0, 0
    for ids in codec.stream((" " + text).replace(" ", "▁")):
        got += ids
        most = max(most, len(ids))
    assert got == codec.encode(text) == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert most < 1000 or len(set(text)) == 1  # committed as it goes


def test_streaming_search_of_scores_is_the_best_one():
    """A model with log probabilities, against a table of all boundaries."""
    rnd = random.Random(6)
    own = sorted({"".join(rnd.choices("abc▁", k=rnd.randint(1, 5))) for _ in range(60)} | set("abc"))
    scores = [0.0] * 256 + [-rnd.uniform(1, 9) for _ in own]
    codec = pieces.Codec([f"<0x{b:02X}>" for b in range(256)] + own, scores, [1] * 256 + [0] * len(own))
    for _ in range(200):
        chars = "".join(rnd.choice("abc▁é中") for _ in range(rnd.randint(1, 300)))
        best = [0.0] + [-1e18] * len(chars)
        for end in range(1, len(chars) + 1):
            if chars[end - 1] not in codec.ids:
                best[end] = best[end - 1] + codec.cost * len(chars[end - 1].encode())
            for start in range(max(0, end - codec.longest), end):
                if chars[start:end] in codec.ids:
                    best[end] = max(best[end], best[start] + scores[codec.ids[chars[start:end]]])
        got = [i for ids in codec.stream(chars) for i in ids]
        assert abs(sum(codec.cost if i in codec.value else scores[i] for i in got) - best[-1]) < 1e-6
        assert sum(len(codec.text[i].replace("▁", " ").encode()) if i not in codec.value else 1 for i in got) == len(chars.replace("▁", " ").encode())


def test_one_worker_encodes_and_decodes(spark, odd):
    got = pieces.round_trip(odd)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = pieces.decode(pieces.encode(odd)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, list(r["ids"]))
    rows = got.collect()
    assert sorted(map(key, rows)) == sorted(map(key, want)) and all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in rows)


def test_remembered_pairs_and_beginnings_are_bounded(codec, monkeypatch):
    text = "The quick brown fox, 12345 jumps over the lazy d\u00f6g \u65e5\u672c\u8a9e internationalization " * 3
    want = codec.whole(text)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    monkeypatch.setattr(pieces, "HEADS", 5)
    own = pieces.Codec(*pieces.load())
    assert own.encode(text) == own.whole(text) == want
    assert max(len(x) + len(x.old) for x in (own.apart, own.heads)) <= 10


def test_pieces_odd(spark, odd, none):
    got = pieces.round_trip(odd)
    assert got.where("exact").count() == len(ODD)
    assert pieces.round_trip(none).count() == 0


def test_clashing_names_are_refused(odd):
    with pytest.raises(ValueError, match="already in use"):
        pieces.encode(odd.withColumn("ids", F.lit(1)))


# -- pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        docs = Scratch(spark, "t").save(stage(spark, docs, small))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "minhash near-dedup":
            roots = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, r in roots.items() if i == r}
    assert docs.where("exact").count() == docs.count() > 0
    assert cp.run(spark, small).count() == docs.count()
