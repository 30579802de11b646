"""HTML main text by wrappers: union-free regular expressions inferred from the pages of one host.

A page becomes a stream of tokens (block tags, and text slots named by their containers). Within a page, neighbouring
equal groups of tokens collapse into a repeated group. Text that more than half of a host's distinct pages have (three of
them at least) may be the template's and stands as a token of its own; other text is a slot. The streams of a host's pages are then
aligned one after another: where they agree the wrapper stays, a group that is repeated in one and single in the other becomes
repeated, and what only one of them has becomes optional. The result has no alternatives, so it is union-free.
Every page is aligned with its host's wrapper. Text that goes together with the wrapper's same text is boilerplate; the other
text fills slots, repeated and optional groups' included. Of these the main text is what stands in the page's article container, or, on a
page without one, what stands outside menus, headers, footers, sidebars, notices, adverts, forms and comments.

The wrapper of a host is folded over distinct streams, in salted parts first, one stream at a time: a task holds one wrapper,
however many pages a host has.

Edge cases: null or empty html gives an empty text; unclosed and unknown tags, broken entities and cut-off pages are read as far
as they go; a host of fewer than three distinct pages has no text known as the template's; urls without a host share one wrapper; repeated rows are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import map_texts, materialise, table
from codexa.llm.urls import host_of

SALTS, PAGES = 16, 2000
TEXT, FIXED = "#", "="
LEAST_PAGES = 3

#: Element kinds of HTML, and what names a container's purpose.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL_END = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
RAW = frozenset("script style noscript template textarea iframe svg title select".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset head".split())
MAIN = frozenset("article main".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu modal nav navbar navigation newsletter notice notices popup promo related reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget navigation contentinfo complementary search form dialog alert".split()
)
MAIN_NAMES = frozenset("article main entry post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|<|[^<]++""",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)


def purpose(tag: str, attributes: str) -> str:
    """chrome, main or nothing: what a container is for."""
    if tag in CHROME:
        return "chrome"
    names, role_main = set(), False
    for key, value in _NAMES.findall(attributes):
        words = set(re.split(r"[\s_\-]+", value.strip("\"'").lower()))
        names |= words
        role_main |= key.lower() == "role" and "main" in words
    if tag not in ("body", "html", *MAIN) and names & CHROME_NAMES:
        return "chrome"
    return "main" if tag in MAIN or role_main or (tag in ("div", "section") and names & MAIN_NAMES) else ""


def stream(page) -> tuple[list[str], list[str | None]]:
    """Symbols of a page, and for each text slot its text (blocks: white space folded, references decoded)."""
    symbols: list[str] = []
    texts: list[str | None] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            kinds = {kind for _, kind in stack}
            place = "chrome" if "chrome" in kinds else "main" if "main" in kinds else "page"
            symbols.append(f"{TEXT}{place}")
            texts.append(text)

    for m in _TOKEN.finditer(page if isinstance(page, str) else ""):
        raw = m[0]
        tag = (m[3] or m[6] or "").lower()
        if raw[0] != "<" or raw == "<":
            held.append(raw)
        elif tag and tag not in INLINE:
            flush()
            closing = bool(m[2] or m[5])
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        del stack[depth:]
                        break
                if tag in OPTIONAL_END or tag in VOID:
                    continue
            elif tag not in VOID:
                if tag in OPTIONAL_END:  # an open one of its kind ends here
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == tag:
                            del stack[depth:]
                            break
                        if stack[depth][0] not in OPTIONAL_END:
                            break
                stack.append((tag, purpose(tag, m[4] or m[7] or "")))
            symbols.append(("/" if closing else "") + tag)
            texts.append(None)
        elif tag == "br":
            held.append(" ")
    flush()
    return symbols, texts


def collapse(symbols: tuple, longest: int = 8) -> list[tuple[object, int]]:
    """(item, width): neighbouring equal groups become ("+", group); width counts the symbols that an item stands for."""
    items = [(s, 1) for s in symbols]
    while True:
        out, i, changed = [], 0, False
        while i < len(items):
            for size in range(1, min(longest, (len(items) - i) // 2) + 1):
                group = [x for x, _ in items[i : i + size]]
                end = i + size
                while [x for x, _ in items[end : end + size]] == group:
                    end += size
                if end > i + size:
                    body = group[0] if size == 1 and isinstance(group[0], tuple) and group[0][0] == "+" else ("+", tuple(group))
                    out.append((body, sum(w for _, w in items[i:end])))
                    i, changed = end, True
                    break
            else:
                out.append(items[i])
                i += 1
        items = out
        if not changed:
            return items


def _bare(item):
    """What an item is like, whether optional or repeated."""
    while isinstance(item, tuple) and item[0] in "?+" and len(item[1]) == 1:
        item = item[1][0]
    return item[1] if isinstance(item, tuple) else item


def _starts(a) -> tuple:
    return a[1] if isinstance(a, tuple) else (a,)


def align(wrapper: list, items: list) -> list[tuple[int | None, int | None]]:
    """Pairs of places that go together, gaps as None: the most matches in order (ties: the wrapper's own order)."""
    a, b = [_bare(x) for x in wrapper], [_bare(x) for x in items]
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    n, m = len(a) - lead, len(b) - lead
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[lead + i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[lead + j] else max(below[j], row[j + 1])
    out: list[tuple[int | None, int | None]] = [(k, k) for k in range(lead)]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[lead + i] == b[lead + j]:
            out.append((lead + i, lead + j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((lead + i, None))
            i += 1
        else:
            out.append((None, lead + j))
            j += 1
    return out


def _is(kind: str, item) -> bool:
    return isinstance(item, tuple) and (item[0] == kind or (item[0] == "?" and len(item[1]) == 1 and _is(kind, item[1][0])))


def grow(wrapper: list | None, items: list) -> list:
    """The wrapper that also accepts ``items`` (a page's, or another wrapper's)."""
    if wrapper is None:
        return list(items)
    out = []
    for i, j in align(wrapper, items):
        if i is None or j is None:
            item = wrapper[i] if j is None else items[j]
            out.append(item if isinstance(item, tuple) and item[0] == "?" else ("?", (item,)))
        else:
            x, y = wrapper[i], items[j]
            repeated = _is("+", x) or _is("+", y)
            optional = any(isinstance(z, tuple) and z[0] == "?" for z in (x, y))
            body = _bare(x)
            item = ("+", body if isinstance(body, tuple) else (body,)) if repeated else x if not isinstance(x, tuple) else x[1][0] if x[0] == "?" else x
            out.append(("?", (item,)) if optional else item)
    return out


def _freeze(x):
    return tuple(map(_freeze, x)) if isinstance(x, list) else x


def dump(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def load(data: str) -> list:
    return [_freeze(x) for x in json.loads(data)]


def shown(wrapper: list) -> str:
    """The wrapper as a regular expression."""
    say = lambda x: x if isinstance(x, str) else f"({' '.join(map(say, x[1]))}){x[0]}"
    return " ".join(map(say, wrapper))


def key_of(symbol: str, text: str) -> int:
    """64 bits that tell a text and its place from others."""
    return int.from_bytes(hashlib.blake2b(f"{symbol} {text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def keyed(page) -> tuple[list[str], list[str | None], list[int]]:
    """A page's symbols and texts, and the keys of its text symbols in their order."""
    symbols, texts = stream(page)
    return symbols, texts, [key_of(s, t) for s, t in zip(symbols, texts, strict=True) if t is not None]


def marked(symbols, keys, fixed: frozenset[int]) -> tuple[str, ...]:
    """The symbols, with a token of its own for each text that may be the template's."""
    rest = iter(keys)
    return tuple((f"{FIXED}{k}" if (k := next(rest)) in fixed else s) if s[0] == TEXT else s for s in symbols)


@lru_cache(maxsize=2000)
def chosen(wrapper: str, symbols: tuple, tokens: tuple) -> tuple[int, ...]:
    """Places in a page's stream whose text, by the alignment with the wrapper, isn't the template's but the article's."""
    items = collapse(tokens)
    begin = [0]
    for _, width in items:
        begin.append(begin[-1] + width)
    wanted = f"{TEXT}main" if f"{TEXT}main" in symbols else f"{TEXT}page"
    out = []
    for i, j in align(load(wrapper), [x for x, _ in items]):
        if j is not None:
            # a template's text where the wrapper doesn't have it is the page's own
            out += [k for k in range(begin[j], begin[j + 1]) if symbols[k] == wanted and (i is None or tokens[k][0] == TEXT)]
    return tuple(sorted(out))


def parsed(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, symbols, keys) of the distinct pages."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            found = [(host, " ".join(symbols), keys) for host, (symbols, _, keys) in zip(frame["host"], map(keyed, frame["html"]), strict=True)]
            yield pd.DataFrame(found, columns=["host", "symbols", "keys"])

    return pages.select("host", "html").mapInPandas(run, "host string, symbols string, keys array<long>").distinct()


def fixed_texts(streams: DataFrame) -> DataFrame:
    """(host, keys) of distinct pages -> (host, fixed): keys of the texts of more than half of a host's pages; twice a page's at most."""
    hosts = streams.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    counted = streams.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("c"))
    often = counted.where(F.col("c") >= LEAST_PAGES).join(hosts, "host").where(F.col("c") * 2 > F.col("n"))
    return often.groupBy("host").agg(F.collect_list("key").alias("fixed"))


def streams(pages: DataFrame) -> DataFrame:
    """(host, symbols, keys, fixed) -> (host, stream): each page's collapsed stream, once for each task."""

    def run(frames):
        import pandas as pd

        seen: set[tuple[str, str]] = set()
        for frame in frames:
            found = zip(frame["host"], frame["symbols"], frame["keys"], frame["fixed"], strict=True)
            rows = {(host, dump([x for x, _ in collapse(marked(symbols.split(), keys, _fixed(fixed)))])) for host, symbols, keys, fixed in found} - seen
            if len(seen) < 100_000:
                seen |= rows
            yield pd.DataFrame(sorted(rows), columns=["host", "stream"])

    return pages.select("host", "symbols", "keys", "fixed").mapInPandas(run, "host string, stream string").distinct()


def _fixed(keys) -> frozenset[int]:
    return frozenset() if keys is None else frozenset(map(int, keys))


def _fold(frames):
    """(host, stream), sorted by host -> (host, wrapper), one stream at a time."""
    import pandas as pd

    host, wrapper = None, None
    for frame in frames:
        done = []
        for name, data in zip(frame["host"], frame["stream"], strict=True):
            if name != host and wrapper is not None:
                done.append((host, dump(wrapper)))
                wrapper = None
            host, wrapper = name, grow(wrapper, load(data))
        if done:
            yield pd.DataFrame(done, columns=["host", "stream"])
    if wrapper is not None:
        yield pd.DataFrame([(host, dump(wrapper))], columns=["host", "stream"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, wrapper, fixed)."""
    shape = "host string, stream string"
    distinct = materialise(parsed(pages), "page-streams")
    fixed = fixed_texts(distinct)
    parts = streams(distinct.join(fixed, "host", "left")).withColumn("salt", F.pmod(F.xxhash64("stream"), F.lit(SALTS)))
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "stream").select("host", "stream").mapInPandas(_fold, shape)
    whole = parts.repartition("host").sortWithinPartitions("host", "stream").mapInPandas(_fold, shape)
    return whole.select("host", F.col("stream").alias("wrapper")).join(fixed, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = materialise(wrappers(hosted), "page-wrappers")
    # a host with more than a thousandth of all pages (there are no more than a thousand of them) is dealt into parts
    counts = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    limit = max(PAGES, total // 1000)
    large = counts.where(F.col("c") > limit).select("host", (F.col("c") / limit).cast("int").alias("parts"))
    dealt = hosted.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), 1 + F.coalesce("parts", F.lit(0))).cast("int")).drop("parts")
    copies = found.join(F.broadcast(large), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(0))))).drop("parts")
    joined = dealt.join(copies, ["host", "part"], "left")

    def each(pages, wrappers_, fixed_):
        out = []
        for page, wrapper, fixed in zip(pages, wrappers_, fixed_, strict=True):
            symbols, texts, keys = keyed(page)
            out.append("\n\n".join(texts[k] for k in chosen(wrapper, tuple(symbols), marked(symbols, keys, _fixed(fixed)))))
        return [out, [len(x) for x in out]]

    return map_texts(joined, ["page_id", "url"], lambda: each, "text string, n_chars long", "html", ("wrapper", "fixed"))


def query(spark, sf_dir):
    """op8: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
