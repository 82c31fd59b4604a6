import html
import re
from math import fsum

import numpy as np
import pytest

from panelcast.llm import ann
from panelcast.llm.html import extract_main_text, main_text

EN = "This is the text of the article and it has a number of words that are common in the language, so that it is read as prose by the rules."
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of the day</a></li></ul></nav>"


def test_pages_of_the_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_what_is_not_the_article_goes():
    page = f"""<html lang=en><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script><style>p {{}}</style></head><body class="has-sidebar">
    <div id="cookie-notice"><p>{EN}</p></div><header><h1>Site name</h1></header>{MENU}
    <main><article><header><h1>Title &amp; more</h1></header><p>{EN}<p>Short.</p><table><tr><td>1 | 2</td></tr></table>
    <div class="adBanner">{EN}</div><aside>{EN}</aside><form><input value=x>Name<textarea>{EN}</textarea></form>
    <p>Second&nbsp;part <b>of</b>\n it.</p><section id="comments"><p>{EN}</p></section></article></main>
    <div class="related-posts"><p>{EN}</p></div><!-- <p>{EN}</p> --><footer>&copy; {EN}</footer></body></html>"""
    assert main_text(page) == f"Title & more\n{EN}\nShort.\n1 | 2\nSecond part of it."


def test_without_containers_the_text_rules_decide():
    page = f"<body>{MENU}<p>Intro</p><p>{EN} {EN}</p><p>So it is.</p><p>{EN} {EN}</p><ul><li><a href=x>Link to the rest of it</a></li></ul><div>xq zv pw {'kj ' * 60}</div></body>"
    assert main_text(page) == "\n".join([f"{EN} {EN}", "So it is.", f"{EN} {EN}"])


def test_broken_pages():
    assert main_text("") == main_text("<") == main_text("<script>") == main_text("<!-- ") == ""
    assert main_text("<article><p>a &am") == "a &am" and main_text("<article>x</div></article></article>y") == "x"
    assert len(main_text("<article>" + "<p>word " * 100_000)) == 5 * 100_000 - 1


def test_odd_pages(spark):
    rows = [(1, None, "<article>a</article>", 1), (1, None, "<article>a</article>", 1), (None, "u", None, 2), (2, "u", "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_main_text(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


def exact(rows, queries, k=20):
    out = {}
    for q, v in queries:
        s = sorted((-fsum(a * b for a, b in zip(x, v)), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = s[:k]
    return out


def run(spark, rows, queries, **options):
    schema = "vec_id long, embedding array<float>, label int"
    df, asked = (spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in x], schema) for x in (rows, queries))
    got = {}
    for r in ann.search(df, asked, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype("f4").tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, []), (206, [1.0, 2.0, 3.0])]
    queries = [r for r in rows if r[0] % 20 == 0]
    want = exact([r for r in rows if r[0] < 200], [q for q in queries if q[0] < 200])
    got = run(spark, rows, queries)
    assert got == want and run(spark, rows, [(206, [1.0, 2.0, 3.0])]) == {}
    assert run(spark, rows[:5], rows[:5]) == exact(rows[:5], rows[:5]) and run(spark, [], []) == {}


def test_a_sparse_cell_ascends_to_the_root(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).astype("f4").tolist()) for i in range(300)]
    got = run(spark, rows, rows[:10], trees=1, cell=4, share=0.01)
    assert all(len(v) == 20 for v in got.values())


def test_recall_over_lengths_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 60)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(32) * rng.uniform(0.5, 2)).astype("f4").tolist()) for i in range(5_000)]
    rows += [(5_000 + i, rows[3][1]) for i in range(100)]
    queries = rows[::40]
    got, want = run(spark, rows, queries, cell=300), exact(rows, queries)
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9


def test_ascent_passes_the_borders_of_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_NEIGHBOUR", 1)
    rng = np.random.default_rng(4)
    # most vectors lie to one side, so that the other side's cells hold little
    rows = [(i, (rng.standard_normal(24) + 0.5 * (i % 4 > 0)).astype("f4").tolist()) for i in range(4_000)]
    queries = [(10_000 + i, (rng.standard_normal(24) - 0.3).astype("f4").tolist()) for i in range(40)]
    assert ann.cell_bits(4_000, 8, 20, int(1.5 * 4_000) + 20) == 2
    got, want = run(spark, rows, queries, trees=8, cell=20, share=1.5), exact(rows, queries)
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.85
    # a share that only whole trees hold is everything
    assert run(spark, rows, queries[:5], trees=8, cell=20, share=8.0) == exact(rows, queries[:5])


def test_cells_hold_what_the_share_promises():
    for n in (5_000, 48_000, 100_000, 1_000_000, 10**9):
        target = int(ann.SHARE * n) + ann.PER_NEIGHBOUR * 20
        assert ann.TREES * n / 2 ** ann.cell_bits(n, ann.TREES, ann.CELL, target) >= target


def test_a_vector_is_dealt_once_however_many_trees_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).astype("f4").tolist()) for i in range(2_000)]
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    dealt, kind = [], type(spark.range(0))
    plain = kind.mapInArrow

    def mapped(self, func, *rest, **more):
        if {"role", "vec"} <= set(self.columns):
            dealt.append(self.where("role = 0"))
        return plain(self, func, *rest, **more)

    monkeypatch.setattr(kind, "mapInArrow", mapped)
    got = run(spark, rows, rows[::20], cell=100)
    assert len(got) == 100 and [d.count() for d in dealt] == [2_000]


def test_lists_of_a_query_do_not_grow_in_number_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).astype("f4").tolist()) for i in range(2_400)]
    written, plain = [], ann.materialise

    def kept(df, label):
        out = plain(df, label)
        if label == "hits":
            written.append(out.count())
        return out

    monkeypatch.setattr(ann, "materialise", kept)
    for n in (1_200, 2_400):
        assert run(spark, rows[:n], rows[:n:20], cell=100, share=30.0) == exact(rows[:n], rows[:n:20])
    assert written[1] <= 2.1 * written[0]
    # vectors past their queries in pieces, and queries in chunks, give the same and no more
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "HELD_QUERIES", 50)
    monkeypatch.setattr(ann, "QUERY_SLICE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert run(spark, rows, rows[::20], cell=100, share=30.0) == exact(rows, rows[::20])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert written[2] == written[1]


def test_the_ascent_gives_what_the_trees_hold_at_the_common_level(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(12).astype("f4").tolist()) for i in range(1_500)]
    x = np.asarray([v for _, v in rows], float)
    longest = float(np.linalg.norm(x, axis=1).max())
    trees, share = 6, 0.02
    got = run(spark, rows, rows[::100], trees=trees, cell=50, share=share, k=5)
    held = [ann.strings(ann.lift(x, longest), t) for t in range(trees)]
    for q, v in rows[::100]:
        v = np.asarray(v, float)
        own = [ann.strings(np.hstack([v / np.linalg.norm(v), 0.0])[None], t)[0] for t in range(trees)]
        under = lambda d: [(h >> np.uint64(64 - d)) == (o >> np.uint64(64 - d)) if d else np.ones(len(h), bool) for h, o in zip(held, own)]  # noqa: E731, B023
        target = int(share * len(rows)) + ann.PER_NEIGHBOUR * 5
        level = max((d for d in range(65) if sum(m.sum() for m in under(d)) >= target), default=0)
        met = np.flatnonzero(np.any(under(level), axis=0))
        assert got[q] == exact([rows[i] for i in met], [(q, v.tolist())], 5)[q]


GOOD = "the word and of it is good text for you. " * 12


@pytest.mark.parametrize("page, want", [
    ('<article><p class="x>Hello there</p><p>More</p></article>', "Hello there\nMore"),
    (f"<body><form><div><article><p>{GOOD}</p></article></div></form></body>", GOOD.strip()),
    (f'<article><p>{GOOD}</p><p class="comment">{GOOD}</p><h2 id="related">See</h2><ul><li class="share">share<li>kept</ul></article>', GOOD.strip() + "\nkept"),
    ('<p class="never closed', ""),
    (f'<form><p>{GOOD}</p></form>', ""),
])
def test_unclosed_quotes_forms_and_marked_blocks(page, want):
    assert main_text(page) == want


def test_the_language_is_found_behind_a_long_head():
    page = "<!--" + "x" * 5_000 + '--><html lang="de"><body><p>' + "der die und in den von zu das mit sich ein Wort mehr noch dazu. " * 5 + "</p></body></html>"
    assert main_text(page).startswith("der die")
