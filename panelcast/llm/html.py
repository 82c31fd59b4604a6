"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classes each block by where it stands, its length, its
link density and its density of stop words: good, bad, or ambiguous. In the second pass ambiguous blocks inherit
the labels of the nearest decided blocks before and after them. Menus, headers, footers, side bars, notices,
adverts, forms, scripts, styles and reader comments are bad wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import byte_slices

STOP = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son sa aux cette ces mais comme on tout nous sous elle leur été être fait ont ses",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos",
}
STOP_WORDS = {k: frozenset(v.split()) for k, v in STOP.items()}

BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements that hold other blocks; the path of open ones decides where a block stands.
HOLDERS = frozenset("article aside body button details dialog div dl fieldset figure footer form head header iframe li main menu nav object ol section select table template textarea title ul noscript svg span".split())
BAD_TAGS = frozenset("aside button dialog footer form head iframe menu nav noscript object select svg template textarea title".split())
CONTENT_TAGS = frozenset(("article", "main"))
BAD_MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disqus discussion dropdown footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split())
CONTENT_MARKS = frozenset("article articlebody body content entry main maincontent post story text".split())
BAD_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
RAW = frozenset("script style noscript template svg textarea iframe".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)  # the last one where a quote is never closed
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Lengths in characters and densities of the rules.
SHORT, LONG, LINK_DENSITY, STOP_LOW, STOP_HIGH = 70, 200, 0.5, 0.15, 0.3


def _kind(tag: str, attributes: str, inside: bool) -> str | None:
    """What an opened element makes of its content: `bad`, `content`, or nothing. `inside`: already in content."""
    if tag in BAD_TAGS or (tag == "header" and not inside):
        return "bad"
    kind = "content" if tag in CONTENT_TAGS else None
    if attributes:
        for name, value in MARKS.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return "bad"
            if name == "role":
                if value.lower() in BAD_ROLES:
                    return "bad"
                kind = "content" if value.lower() in ("main", "article") else kind
            elif name in ("class", "id") and tag not in ("html", "body"):
                parts = set(PART.findall(CAMEL.sub(" ", value).lower()))
                if parts & BAD_MARKS and not (inside and tag == "header"):
                    return "bad"
                kind = "content" if parts & CONTENT_MARKS and tag != "span" else kind
    return kind


def blocks_of(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters inside links, stands in a bad element, number of the content container or -1) in page order."""
    out, parts, links, in_link = [], [], 0, 0
    path: list[tuple[str, str | None, int]] = []  # (tag, bad or content or None, container)
    bad, container, containers = 0, -1, 0
    marked = False  # the paragraph or heading at hand is itself marked as a comment, an advert and so on
    at, n = 0, len(html)

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, links, bad > 0 or marked, container))
            parts.clear()
        links = 0

    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            text = unescape(text)
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        slash, name, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if name is None:
            continue
        tag, closing = name.lower(), bool(slash)
        if tag in BLOCK:
            end_block()
            in_link = 0
            marked = not closing and tag not in HOLDERS and _kind(tag, attributes, container >= 0) == "bad"
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        if closing:
            if tag in HOLDERS:
                for i in range(len(path) - 1, -1, -1):
                    if path[i][0] == tag:
                        if tag == "span" and path[i][1] == "bad":
                            end_block()
                        bad -= sum(k == "bad" for _, k, _ in path[i:])
                        container = path[i][2]
                        del path[i:]
                        break
            continue
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag in HOLDERS and not attributes.endswith("/"):
            kind = _kind(tag, attributes, container >= 0)
            if tag == "span" and kind == "bad":
                end_block()
            if tag == "li":  # ends an item left open in the same list
                for i in range(len(path) - 1, -1, -1):
                    if path[i][0] in ("ul", "ol", "menu"):
                        break
                    if path[i][0] == "li":
                        bad -= sum(k == "bad" for _, k, _ in path[i:])
                        container = path[i][2]
                        del path[i:]
                        break
            if tag in CONTENT_TAGS and kind == "content" and bad and all(t == "form" for t, k, _ in path if k == "bad"):
                # a form round the whole page hides nothing of its article
                path[:] = [(t, None if k == "bad" else k, c) for t, k, c in path]
                bad = 0
            path.append((tag, kind, container))
            bad += kind == "bad"
            if kind == "content" and container < 0:
                container, containers = containers, containers + 1
    end_block()
    return out


def stop_density(text: str, words: frozenset[str] | None) -> float:
    tokens = [w.strip(".,;:!?\"'()[]*%$&#|") for w in text.lower().split()]
    if not tokens:
        return 0.0
    lists = [words] if words else STOP_WORDS.values()
    return max(sum(t in s for t in tokens) for s in lists) / len(tokens)


def first_pass(text: str, links: int, bad: bool, container: int, words: frozenset[str] | None) -> str:
    """"out" by its place, "bad" by its links, "good", or ambiguous: "short", "near" (middling density), "thin" (few stop words)."""
    if bad:
        return "out"
    if links > LINK_DENSITY * len(text):
        return "bad"
    if len(text) < SHORT:
        return "short"
    density = stop_density(text, words)
    if density >= STOP_HIGH:
        return "good" if len(text) >= LONG or container >= 0 else "near"
    return "near" if density >= STOP_LOW else "thin"


def second_pass(first: Sequence[str], containers: Sequence[int]) -> list[bool]:
    """Whether each block is main text: ambiguous blocks inherit from the nearest decided block on either side.

    In a content container only its own blocks count, those that stand in bad elements do not, and an ambiguous block is
    left out only between two bad ones: tables, symbols and one-word paragraphs of an article are its text. Outside,
    where both sides differ, the nearer one decides, the bad one at a tie, and a good one decides for middling blocks.
    """
    n = len(first)
    near: list[list[tuple[int, bool]]] = [[] for _ in first]
    for side in (range(n), range(n - 1, -1, -1)):
        last: dict[int, int] = {}  # the decided block passed last, by container
        for i in side:
            if (j := last.get(containers[i])) is not None:
                near[i].append((abs(j - i), first[j] == "good"))
            if first[i] in ("good", "bad") or first[i] == "out" and containers[i] < 0:
                last[containers[i]] = i
    out = []
    for kind, container, found in zip(first, containers, near):
        if kind in ("good", "bad", "out"):
            out.append(kind == "good")
        elif container >= 0:
            out.append(len(found) < 2 or any(good for _, good in found))
        elif kind == "thin" or not found:
            out.append(kind == "near")
        elif kind == "near":
            out.append(any(good for _, good in found))
        else:
            out.append(min(found)[1])
    return out


def main_text(html: str) -> str:
    """The main text: kept blocks in page order, one per line."""
    lang = re.search(r"<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", html)
    words = STOP_WORDS.get(lang.group(1).lower()) if lang else None
    blocks = blocks_of(html)
    first = [first_pass(*b, words) for b in blocks]
    kept = second_pass(first, [b[3] for b in blocks])
    return "\n".join(b[0] for b, k in zip(blocks, kept) if k)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text (empty if none), n_chars. Null html is empty; repeated rows are extracted alike."""
    rows = pages.select(F.col(key), F.col(url), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    schema = T.StructType([rows.schema[key], rows.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "html"):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
