import html
import random
import re

from labelloom.llm import wrapper as W


def page(k: int, body: str, host: str = "a.example") -> tuple:
    nav = "".join(f'<li><a href="/{k}{j}">n{k}{j}</a></li>' for j in range(3))
    source = (
        f"<!DOCTYPE html><html><head><title>t{k}</title><script>var t='</p>';</script><style>p{{}}</style></head><body><header>Site {k}</header><nav><ul>{nav}</ul></nav>"
        f'<div class="cookie-notice">We use cookies</div><div class="wrap">{body}</div><aside>side {k}</aside><div id="ad-{k}" class="ad">buy {k}</div>'
        f'<form><input name="q"><button>Go</button></form><section id="comments"><p>reader {k}</p></section><footer>&copy; {k}</footer></body></html>'
    )
    return k, f"https://{host}/{k}", source


def texts(spark, rows, **more) -> dict:
    out = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **more)
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_article_without_the_rest(spark):
    rows = [page(k, f"<article><h1>Title {k}</h1><p>First&nbsp;<b>bo</b>ld &amp; {k}<br>line<p>Second\n {k}</p><ul><li>x{k}<li>y</ul><!-- no --></article>") for k in range(5)]
    for many in (50_000, 0):
        assert texts(spark, rows, max_rules=many) == {k: f"Title {k} First bold & {k} line Second {k} x{k} y" for k in range(5)}


def test_region_found_by_alignment(spark):
    """No article or main: the wrapper's varying slots show where the content is; constant single nodes are template."""
    rows = [page(k, f'<div class="x9"><div class="k">Share this</div><h2>Head {k}</h2><p>Text {k} with many words and {k * 7}</p><p>More {k}</p></div>') for k in range(6)]
    assert texts(spark, rows) == {k: f"Head {k} Text {k} with many words and {k * 7} More {k}" for k in range(6)}


def test_simple_tree_matching():
    slot = lambda label, *children: W.Slot("=" + label, list(children), 1, 0, 0.0)
    a = slot("a", slot("b", slot("d")), slot("c"))
    b = slot("a", slot("x"), slot("b", slot("d")), slot("c", slot("e")))
    assert W.matching(a, b, {}) == 4 and W.matching(a, slot("z"), {}) == 0
    W.align(a, b, {})
    assert [c.label for c in a.children] == ["=x", "=b", "=c"] and a.pages == 2


def most_pairs(a, b) -> int:
    """The largest matching, by trying every one: each child of a with each later child of b, or with none."""
    if a.label != b.label:
        return 0

    def best(left, right):
        if not left or not right:
            return 0
        return max([best(left[1:], right)] + [most_pairs(left[0], right[j]) + best(left[1:], right[j + 1 :]) for j in range(len(right))])

    return 1 + best(a.children, b.children)


def test_matching_by_brute_force():
    rng = random.Random(4)

    def tree(depth: int):
        return W.Slot("=" + rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [], 1, 0, 0.0)

    for _ in range(200):
        a, b = tree(2), tree(2)
        assert W.matching(a, b, {}) == most_pairs(a, b)


NEUTRAL = re.compile(r"<(/?)(?:nav|article|footer|header|aside|section|main)\b[^>]*>")


def test_neutral_tags_give_the_same_by_induction(spark, sf_dir):
    """The test pages with every telling tag, class, id and role gone, and all pages on a few hosts: what varies
    most over a host's pages is the content; a page alone does not show it."""
    rows = [(r["page_id"], f"http://host{r['page_id'] % 4}/", r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    plain = [(k, u, re.sub(r' (?:class|id|role)="[^"]*"', "", NEUTRAL.sub(r"<\1div>", h))) for k, u, h in rows]
    tagged, neutral = texts(spark, rows), texts(spark, plain)
    assert sum(tagged[k] == neutral[k] for k in tagged) >= 0.98 * len(tagged)


def test_constant_paragraph_is_template_and_siblings_are_not(spark):
    notice = "This notice stands on every page of the host, in a plain paragraph of its own."
    rows = [page(k, f"<div><div><p>{notice}</p></div><div><h2>Head {k}</h2><p>Text {k} goes on.</p><p>More {k}</p></div></div>") for k in range(5)]
    assert texts(spark, rows) == {k: f"Head {k} Text {k} goes on. More {k}" for k in range(5)}
    inside = [page(k, f"<article><h1>Head {k}</h1><blockquote>{notice}</blockquote><p>Text {k}</p></article>") for k in range(5)]
    assert texts(spark, inside) == {k: f"Head {k} Text {k}" for k in range(5)}


def test_wrappers_merge_as_a_tree(spark):
    rows = [page(k, "".join(f"<div><h{1 + j % 3}>H{k}{j}</h{1 + j % 3}></div>" for j in range(k % 7)) + f"<div><h2>Head {k}</h2><p>Text of page {k}, longer than the others by far, {'so it goes on ' * 9}{k}.</p></div>") for k in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    by_tree, at_once = ({(r[0], bytes(r[1])): tuple(r[2]) for r in W.rules(frame, fan=n).collect()} for n in (2, 64))
    assert by_tree.keys() == at_once.keys() and sum(by_tree[k] == at_once[k] for k in by_tree) >= 0.8 * len(by_tree)


def test_unclosed_quote(spark):
    assert texts(spark, [(0, "u", 'a <a title="x>b</a> c')]) == {0: "a b c"}


def test_test_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in W.extract(rows).collect()}
    for r in rows.collect():
        inside = r["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", "\n"))).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_odd_pages(spark):
    rows = [(0, None, None), (1, "", ""), (2, "x", "plain & text"), (3, "http://h/", "<p>one<p>two"), (4, "http://h/", "<p>one<p>two"), (5, "http://h/q", "<" * 500 + "<div" * 300), (6, "http://h/q", "<div>" * 900 + "deep"), (7, None, "<p>" + "long " * 60_000)]
    got = texts(spark, rows)
    assert got[0] == got[1] == "" and got[2] == "plain & text" and got[3] == got[4] == "one two"
    assert got[7] == ("long " * 60_000).strip() and got[6].endswith("deep") and len(got) == 8
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert W.extract(empty).count() == 0


def test_regions_are_weighed_by_varying_text(spark):
    """A long text that is the same on every page outweighs no region, marked or not, however short the rest."""
    same = "These terms are the same on every page. " * 40
    for mark in ("content", "x9"):
        rows = [page(k, f'<div class="left"><div class="{mark}"><p>{same}</p></div></div><div class="right"><div class="{mark}"><h2>Head {k}</h2><p>Text {k}</p></div></div>') for k in range(5)]
        assert texts(spark, rows) == {k: f"Head {k} Text {k}" for k in range(5)}


def test_pages_that_do_not_vary(spark):
    rows = [page(0, "<article><p>All the same</p></article>") for _ in range(4)]
    assert set(texts(spark, rows).values()) == {"All the same"}
