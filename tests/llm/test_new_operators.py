"""Page text, conversation repair and hard negatives against plain versions and on edge cases."""

import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from ledgerguard.llm import hard_negatives as hn
from ledgerguard.llm import html_text, queries, turns

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- 11 page text ----------------------------------------------------------------------------------------------
def plain_article(page):
    """The text of a page's only article element, by its paragraphs."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    got = queries.op11_html_extraction(spark, SF01).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(want)


LONG_A = "The first paragraph is long enough, has commas, and says what the page is about, at some length."
LONG_B = "The second one goes on, with more words, and a few more commas, so that it counts as well."


@pytest.mark.parametrize("page, text", [
    (f"<body><div class=main><p>{LONG_A}</p><p>{LONG_B}</p></div><div class='sidebar'><p>{LONG_A}</p></div></body>", f"{LONG_A}\n{LONG_B}"),
    (f"<body><header><h1>Site</h1><p>{LONG_B}</p></header><article><header><h1>Title</h1></header><p>{LONG_A}</article><footer>{LONG_B}</footer>", f"Title\n{LONG_A}"),
    (f"<div id=content><p>{LONG_A}</p><form><p>{LONG_B}</p></form></div>", LONG_A),
    (f"<form id=page><div><article><h1>T</h1><p>{LONG_A}</p></article></div></form>", f"T\n{LONG_A}"),
    (f"<article><h1>T</h1><p>{LONG_A}</p><h3>2 Comments</h3><div><p>{LONG_B}</p></div></article>", f"T\n{LONG_A}"),
    (f"<article><p>{LONG_A}</p></article><section id=comments><article class=comment><p>{LONG_B}{LONG_B}</p></article></section>", LONG_A),
    (f"<div class=cookie-notice><p>{LONG_A}, {LONG_A}</p></div><div><p>{LONG_B}</p></div>", LONG_B),
    (f"<main><p>{LONG_A}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>{LONG_B}</main>", f"{LONG_A}\n{LONG_B}"),
    ("<table><tr><td>a, b<td>c &lt;d&gt; &amp e</table>", "a, b\nc <d> & e"),
    ("<p>one<br>two  &nbsp; three</p><script>var x = '<p>no</p>';</script><!-- <p>no</p> --><style>p{}</style>", "one two three"),
    ('<div title="a>b">x</div><p title=\'<p>\'>y</p><a href="cut', "x\ny"),
    ("no markup at all", "no markup at all"),
    ("<body class='has-sidebar nav-open'><p>plain</p>", "plain"),
    ("<nav>only</nav><script>x", ""),
    ("", ""),
    (None, ""),
])
def test_page_parts(page, text):
    assert html_text.main_text(page)[0] == text


def test_sibling_containers_are_kept():
    page = f"<body><div class=part><p>{LONG_A * 9}</p></div><div class=part><p>{LONG_B * 9}</p></div><div><a href=x>{LONG_A}</a></div></body>"
    assert html_text.main_text(page)[0] == f"{LONG_A * 9}\n{LONG_B * 9}"


@pytest.mark.parametrize("piece", ["<div>", "<p><b>", "<a href=\"'", "<p title=' =", "<!--", "<script>", "<table><tr><td>", "</p>", "<li>x", "<", "&amp"])
def test_page_time_is_linear(piece):
    began = time.time()
    html_text.main_text(piece * (1_000_000 // len(piece)) + "end")
    assert time.time() - began < 20


def test_page_rows(spark):
    rows = [(None, None, None, "x", 1), (1, "u", "", "x", 1), (1, "u", f"<p>{LONG_A}", "x", 1), (1, "u", f"<p>{LONG_A}", "x", 1),
            (2, None, "<p>" + "w, " * 400000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, score int").repartition(3)
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "container", "score"]
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in got.collect()) == sorted(
        [("None", "None", ""), ("1", "u", ""), ("1", "u", LONG_A), ("1", "u", LONG_A), ("2", "None", ("w, " * 400000).strip())])
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- 12 conversation repair ------------------------------------------------------------------------------------
def cheapest(rows):
    """The least (cost, audit) of (initial, forced, truncated) rows, state by state and row by row."""
    def add(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def filled(table):
        for _ in range(4):
            for s, (c, a) in list(table.items()):
                add(table, "a" if s == "u" else "u", (c + 2, a + "I"))
        return table

    table = filled({"": (0, "")})
    for initial, forced, cut in rows:
        after = {}
        for s, (c, a) in table.items():
            add(after, s, (c + 3, a + "D"))
            if not forced:
                to = "a" if s == "u" else "u"
                add(after, to, (c + 2 + cut, a + "R"))
                if initial == to or initial == "s" and s == "":
                    add(after, initial, (c + cut, a + "K"))
        table = filled(after)
    return min(table[s] for s in ("", "a") if s in table)


def every_way(rows, limit):
    """All (cost, audit) up to a cost, by trying every edit everywhere."""
    found = []

    def go(i, out, cost, audit):
        if cost > limit:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
        for x in "ua":
            go(i, out + x, cost + 2, audit + "I")
        if i < len(rows):
            initial, forced, cut = rows[i]
            go(i + 1, out, cost + 3, audit + "D")
            if not forced:
                go(i + 1, out + initial, cost + cut, audit + "K")
                for x in "ua":
                    go(i + 1, out + x, cost + 2 + cut, audit + "R")
    go(0, "", 0, "")
    return min(found)


def random_rows(rng, n):
    return [(rng.choice("suauauaux"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(n)]


def flagged(rows):
    return [(i, turns.FORCED if forced else turns.TRUNCATED if cut else 0, 1) for i, forced, cut in rows]


def test_search_is_cheapest_and_least():
    rng = random.Random(1)
    for n in range(6):
        for _ in range(30):
            rows = [(i, f, 0 if f else c) for i, f, c in random_rows(rng, n)]
            want = cheapest(rows)
            assert every_way(rows, want[0]) == want
            assert turns.search(flagged(rows), turns.START, turns.FINAL) == want
    for n in (20, 64, 300):
        for _ in range(10):
            rows = [(i, f, 0 if f else c) for i, f, c in random_rows(rng, n)]
            assert turns.search(flagged(rows), turns.START, turns.FINAL) == cheapest(rows)


def test_bounds_never_exceed_the_rest():
    rng = random.Random(2)
    for _ in range(100):
        rows = flagged([(i, f, 0 if f else c) for i, f, c in random_rows(rng, 6)])
        lower = turns.bounds(rows, turns.FINAL)
        for at in range(7):
            for s in range(4):
                assert lower[at][s] <= turns.search(rows[at:], s, turns.FINAL)[0]


def test_search_visits_few_nodes():
    """The bounds and tables keep the search near one visit for each row."""
    rows, seen = flagged(random_rows(random.Random(3), 2000)), [0]

    def counting(entry, state):
        seen[0] += 1
        return turns.steps(entry, state)
    assert turns.search(rows, turns.START, turns.FINAL, counting) < turns.NONE
    assert seen[0] < 2000 * (4 + 3)


def test_pieces_give_the_whole():
    rng = random.Random(4)
    for _ in range(40):
        rows = [(i, f, 0 if f else c) for i, f, c in random_rows(rng, rng.randrange(1, 150))]
        cuts = sorted(rng.sample(range(1, len(rows)), min(rng.choice([3, 60]), len(rows) - 1)))
        assert turns.joined([turns.table_of(flagged(rows[a:b])) for a, b in zip([0, *cuts], [*cuts, len(rows)])]) == cheapest(rows)


def test_a_very_long_conversation():
    rows = flagged([(i, f, 0 if f else c) for i, f, c in random_rows(random.Random(6), 60000)])
    began = time.time()
    cost, audit = turns.joined([turns.table_of(rows[a:a + turns.PIECE]) for a in range(0, len(rows), turns.PIECE)])
    assert len(audit) - audit.count("I") == 60000 and time.time() - began < 120


def plain_repair(rows, damage=True):
    """The contract's columns of every conversation, one row after the other."""
    spaced = lambda x: " " if x is None else str(x)
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 9
        role, text = spaced(role), spaced(text)
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, c in held.items():
        c.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, entries, counts = set(), [], collections.Counter()
        for _, role, text in c:
            word = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            entries.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(entries, entries[1:]))
        t = {r[0] for r in c if r[0] is not None}
        cost, audit = cheapest(entries)
        left, rest, lines = iter(c), len(audit) - audit.count("D"), []
        for letter in audit:
            row = next(left) if letter != "I" else None
            role = "assistant" if rest % 2 else "user"
            if letter != "D":
                lines.append(f"{row[1]}:{row[2]}" if letter == "K" else f"{role}:{row[2]}" if letter == "R" else f"{role}:")
                rest -= 1
        out.append((conv, max(t) - min(t) + 1 - len(t) if t else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLS12 = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows12(df):
    assert df.columns == COLS12
    return sorted((tuple(r[c] for c in COLS12) for r in df.collect()), key=str)


def test_conversations_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows12(queries.op12_conversation_repair(spark, SF01)) == plain_repair(rows)


def test_conversation_edges(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \n", "What? ", "Fine!", None, "long " * 50000 + "."]
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([*range(40), None]), rng.choice(["user", "assistant", "system", "tool", "", None]),
             rng.choice(texts)) for _ in range(600)]
    rows += [(6, t, "user" if t % 2 else "assistant", f"Turn {t % 17}.") for t in range(1000)]  # cut into pieces and tasks
    rows += [(7, 3, "user", "The same.")] * 200 + [(8, t, "user", "The same.") for t in range(200)]
    rows += [(c, 0, "user", "One.") for c in range(100, 160)]  # some of these lose their only row
    extra = [(*r, "x", 1, "h") for r in rows]
    df = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, h string, n int, conv string").repartition(5)
    assert rows12(turns.repair_audit(turns.damaged(df))) == plain_repair(rows)
    assert rows12(turns.repair_audit(turns.counted(df))) == plain_repair(rows, damage=False)
    assert turns.repair_audit(turns.damaged(df.limit(0))).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", ""), (2, 0, "system", "Be kind."), (2, 1, "tool", "Out.")]
    audits, left = turns.repair(turns.counted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {1: (5, "KRD"), 2: (4, "KIR")}
    assert sorted(tuple(r[c] for c in ("conv_id", "place", "role", "text", "turn")) for r in left.collect()) == [
        (1, 0, "user", "Hi.", 0), (1, 1, "assistant", "Still there?", 1),
        (2, 0, "system", "Be kind.", 0), (2, 1, "user", "", None), (2, 2, "assistant", "Out.", 1)]


# ---- 13 hard negatives -----------------------------------------------------------------------------------------
def plain_negatives(rows, every=100):
    """(anchor, positive, rank, negative, scores) of (vec_id, label, embedding) rows, all pairs scored."""
    use = []
    for n, (i, label, x) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        use.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for n, i, label, v in use:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, j, other, w in use if m != n]
        near = sorted((s for s in scored if s[2] == label), key=order)[:5]
        far = sorted((s for s in scored if s[2] != label), key=order)
        for p in near:
            out += [(i, p[1], rank, s[1], p[0], s[0]) for rank, s in
                    enumerate([s for s in far if 30 * p[0] <= 100 * s[0] <= 90 * p[0]][:10], 1)]
    return sorted(out, key=str)


COLS13 = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def rows13(df):
    return sorted((tuple(r[c] for c in COLS13) for r in df.collect()), key=str)


def random_vectors(n, dims, seed):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims)) / math.sqrt(dims)
    return [(i, int(i % 6), (centres[(i + i // 40) % 6] + g.normal(size=dims) / dims).astype("float32").tolist()) for i in range(n)]


SCHEMA13 = "vec_id long, label int, embedding array<float>"


def test_negatives_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert rows13(queries.op13_hard_negatives(spark, SF001)) == plain_negatives(rows)


@pytest.mark.parametrize("slice_rows, group_rows", [(100, 3), (4096, 1024)])
def test_negatives_in_slices(spark, slice_rows, group_rows):
    rows = random_vectors(900, 20, 7)
    rows += [(100, 4, rows[100][2]), (None, 2, rows[3][2]), (901, None, rows[1][2]), (902, 1, None), (903, 1, []), (904, 1, [0.5, None]),
             (905, 1, [float("nan")] * 20), (906, 2, [float("inf")] * 20), (907, 3, [1.0, -1.0])] + [(910, 5, rows[50][2])] * 30
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA13 + ", row int, score string").repartition(4)
    got = hn.hard_negatives(hn.vectors(df, moved=7), slice_rows=slice_rows, group_rows=group_rows)
    assert rows13(got) == plain_negatives(rows)


def test_negatives_empty(spark):
    none = spark.createDataFrame([], SCHEMA13)
    assert hn.hard_negatives(hn.vectors(none, moved=7)).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0])], SCHEMA13)
    assert hn.hard_negatives(hn.vectors(one)).count() == 0


def test_scan_reads_less_than_all():
    """The bounds take most rows out before the last columns; what is left is exact."""
    rows = random_vectors(4000, 64, 8)
    cols = hn.columns([[math.floor(256 * x) for x in r[2]] for r in rows], 64)
    held, labels = hn.Slice(cols), np.array([r[1] for r in rows])
    total = 0
    for a in range(0, 4000, 100):
        q = cols[:, a]
        exact = q @ cols
        got, scores, read = held.scan(q, (labels == labels[a]) & (np.arange(4000) != a), hn.beyond_first(5))
        assert (scores == exact[got]).all()
        best = np.sort(exact[(labels == labels[a]) & (np.arange(4000) != a)])[::-1][:5]
        assert (np.sort(scores)[::-1][:5] == best).all()
        total += read
    assert total < 0.8 * 40 * 64 * (4000 / 6)


def test_scores_too_large(spark):
    rows = spark.createDataFrame([(100, 1, [1e20]), (1, 1, [1e20])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="inner products"):
        hn.hard_negatives(hn.vectors(rows)).count()


@pytest.mark.parametrize("name, table", [("op2_minhash_near_dedup", "documents"), ("op10_suffix_dedup", "documents"),
                                         ("op13_hard_negatives", "embeddings")])
def test_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF001}/{table}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF001)
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(map(tuple, cur.fetchall()), key=str)
