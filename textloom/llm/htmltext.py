"""Main text of web pages: page structure, and a suffix array over each host's pages.

A page is read as a stream of tags and texts. Blocks inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are dropped, by element and by the words of class, id
and role. Where a page marks its article (``article``, ``main``, role main or article), the blocks inside
it are its stream; the suffix array of its host's marked pages decides what of them is furniture that the mark encloses. The mark
speaks for the text, so that takes more than a repeat: a substring of ``run`` tokens goes that is on ``share`` of the host's
marked pages and on ``least`` of them at least. Articles that are copied or quoted on other pages stay whole. Such substrings are found
without a row for each token: one that is on ``share`` of all pages of a host is on that share of those in some chunk of a task's
pages, so a chunk proposes what is frequent in it (of a host with one page there, all), and the proposals are counted over all pages.

Where it does not, a repeat is enough. The host's unmarked pages' token streams are one text whose suffixes are sorted, each down
to ``depth`` tokens; the common prefix of a suffix with the one before it of another page is a substring repeated
across distinct pages if it has ``run`` tokens or more, and every token covered by such a substring is boilerplate and
goes. What remains are the page's unique runs. Spark range-partitions the suffixes by host and their first ``run``
tokens, so a task sees all that can share so much, and walks through them in order holding one page's at most. Suffixes
without a partner need no sorting: a grouped aggregate on hashes of their first ``run`` tokens, which combines
before its shuffle and so bears a host with most of the pages, sorts them out first.
A page all of whose tokens are covered is a copy: it is left whole.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined
by a blank in page order; nothing else is dropped or cut. Null or empty html gives an empty text; a null url
belongs to the host without name; repeated rows are pages of their own with equal results; pages of any length
are read whole, in time in proportion to their length; an empty table gives an empty result. Clashing columns cannot
occur: only id, url and html are read.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, shuffle_width, small_batches

DELIMITER = re.compile("[>\"']")
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9:_-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
DROPPED = RAW | {"nav", "header", "footer", "aside", "form", "head", "noscript", "template", "button", "select", "menu", "option", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Words of class, id and role that mark what is no main text.
SIGNS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "subscription", "alert", "disclaimer",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "complementary", "contentinfo", "search",
}
MAIN = {"article", "main"}


def opening(tag: str, name: str) -> tuple[bool, bool]:
    """Whether an element is dropped and whether it is a main container."""
    dropped, main = name in DROPPED, name in MAIN
    rest = tag[len(name) + 1 : -1]
    if "=" in rest or "hidden" in rest:
        for key, value in ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                if key == "role" and value in MAIN:
                    main = True
                elif name not in ("body", "html", *MAIN) and SIGNS & set(re.split(r"[^a-z0-9]+", value)):
                    dropped = True
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                dropped = True
    return dropped, main


def token_end(text: str, at: int, last: dict[str, int]) -> int:
    """End of the token that begins at ``at``: a comment, section, declaration, tag, run of text, or a lone ``<``.

    ``last`` holds the last places of ``>`` and the quotes, so that nothing is looked for in vain: a page takes
    time in proportion to its length. A tag with an unclosed quote ends at its first ``>``.
    """
    if text[at] != "<":
        end = text.find("<", at)
        return len(text) if end < 0 else end
    for begin, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        if text.startswith(begin, at):
            end = text.find(close, at + len(begin))
            return len(text) if end < 0 else end + len(close)
    begin = text[at + 1 : at + 3]
    named = begin[:1].isascii() and begin[:1].isalpha() or begin[:1] == "/" and begin[1:].isascii() and begin[1:].isalpha()
    if at > last[">"] or not named and begin[:1] not in ("!", "?"):
        return at + 1
    first = text.find(">", at)
    if not named:
        return first + 1
    place = at
    while (hit := DELIMITER.search(text, place)) is not None:
        if hit.group() == ">":
            return hit.end()
        if hit.start() >= last[hit.group()]:
            return first + 1
        place = text.find(hit.group(), hit.end()) + 1
        if place > last[">"]:
            return first + 1
    return first + 1


def page_blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks its main part, and the blocks of that part or, if not, of all that is not dropped."""
    inside, outside, marked = [], [], False
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    drops = mains = 0

    def close() -> None:
        if words:
            block = " ".join(html_module.unescape("".join(words)).split())
            if block:
                (inside if mains else outside).append(block)
            words.clear()

    def leave(depth: int) -> None:
        nonlocal drops, mains
        while len(stack) > depth:
            _, d, m = stack.pop()
            drops, mains = drops - d, mains - m

    text, at = page or "", 0
    last = {c: text.rfind(c) for c in ">\"'"}
    while at < len(text):
        end = token_end(text, at, last)
        token, at = text[at:end], end
        if token[0] != "<" or token == "<":
            if not drops:
                words.append(token)
            continue
        named = NAME.match(token)
        if named is None:
            continue
        name = named.group(1).lower()
        block = name not in INLINE
        if block and not drops:
            close()
        if token[1] == "/":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if block and not drops:
                        close()
                    leave(depth)
                    break
            continue
        if name in VOID or token.endswith("/>") and name not in RAW:
            continue
        if name in RAW:  # its content is no markup
            closing = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            at = closing.end() if closing else len(text)
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            leave(len(stack) - 1)
        if name == "body":  # an unclosed head ends here
            leave(0)
        dropped, main = opening(token, name)
        main = main and not drops
        stack.append((name, dropped, main))
        drops, mains, marked = drops + dropped, mains + main, marked or main
    if not drops:
        close()
    return (True, inside) if marked else (False, outside)


def parsed_pages(pages: DataFrame, html: str, out: str = "_page") -> DataFrame:
    small_batches(pages.sparkSession)

    @F.arrow_udf("marked boolean, blocks array<string>")
    def read(column: pa.Array) -> pa.Array:
        found = [page_blocks(x.as_py()) for x in column]
        return pa.StructArray.from_arrays([pa.array([m for m, _ in found], pa.bool_()), pa.array([b for _, b in found], pa.list_(pa.string()))], ["marked", "blocks"])

    return pages.withColumn(out, read.asNondeterministic()(F.col(html)))


def unique_runs(blocks: list[str] | None, spots: list[dict] | None) -> str:
    """A page's blocks without the tokens covered by repeated substrings (``at``, ``length``)."""
    split = [b.split() for b in blocks or []]
    total = sum(map(len, split))
    gone = bytearray(total)
    for s in spots or []:
        size = min(s["length"], total - s["at"])
        gone[s["at"] : s["at"] + size] = b"\1" * size
    if total and all(gone):
        gone = bytearray(total)
    out, at = [], 0
    for words in split:
        kept = [w for k, w in enumerate(words, at) if not gone[k]]
        at += len(words)
        if kept:
            out.append(" ".join(kept))
    return " ".join(out)


def shared_prefixes(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes (host, suffix, key, at) to those that share ``run`` tokens with one of another page, and how many with the last such.

    Of a group with one prefix of ``run`` tokens, the first page's suffixes wait until another page's comes.
    """
    prefix, last, before, waiting = None, None, None, []  # before: the latest suffix of a page other than the last one's
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for host, suffix, key, at in zip(*(batch.column(c).to_pylist() for c in ("host", "suffix", "key", "at")), strict=True):
            here = (host, suffix[:run])
            if here != prefix:
                prefix, last, before, waiting = here, (key, suffix), None, [(key, at, run)]
                continue
            if key != last[0]:
                before = last[1]
            last = (key, suffix)
            if before is None:
                waiting.append((key, at, run))
                continue
            out, waiting = out + waiting, []
            common = run
            while common < min(len(suffix), len(before)) and suffix[common] == before[common]:
                common += 1
            out.append((key, at, common))
        keys, places, lengths = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), "at": pa.array(places, pa.int32()), "length": pa.array(lengths, pa.int32())})


def repeated_runs(pages: DataFrame, run: int, depth: int) -> DataFrame:
    """``key``, ``at``, ``length``: where the pages (host, key, w) hold a substring that another page of their host holds too."""
    long = pages.where(F.size("w") >= run)
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - (run - 1)), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, run), " ")))
    hashed = long.select("host", "key", F.posexplode(windows).alias("at", "h"))
    shared = hashed.groupBy("host", "h").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("host", "h")
    return sorted_suffixes(long, hashed.join(shared, ["host", "h"], "left_semi"), run, depth)


def sorted_suffixes(pages: DataFrame, found: DataFrame, run: int, depth: int) -> DataFrame:
    """The repeated runs among the suffixes of the pages (host, key, w) at the places ``found`` (key, at)."""
    spots = found.groupBy(F.col("key").alias("k")).agg(F.collect_list("at").alias("spots"))
    held = pages.join(spots, F.col("key") == F.col("k")).select("host", "key", "w", F.explode("spots").alias("at"))
    suffixes = held.select("host", "key", "at", F.slice("w", F.col("at") + 1, F.lit(depth)).alias("suffix"))
    dealt = suffixes.repartitionByRange(shuffle_width(pages.sparkSession), "host", F.slice("suffix", 1, run))
    ordered = dealt.sortWithinPartitions("host", "suffix", "key", "at").select("host", "suffix", "key", "at")
    return ordered.mapInArrow(lambda batches: shared_prefixes(batches, run), "key long, at int, length int")


def window_hashes(blocks: list[str], run: int) -> np.ndarray:
    """A 64-bit value of each ``run`` tokens of a page."""
    words = [w for b in blocks for w in b.split()]
    spans = max(0, len(words) - run + 1)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    mixed = np.full(spans, run, np.uint64)
    for k in range(run if spans else 0):
        mixed = (mixed ^ hashes[k : k + spans]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


#: Pages of a chunk, and values that are broadcast at most.
CHUNK, SENT = 4096, 200_000


def frequent_windows(batches: Iterator[pa.RecordBatch], run: int, share: float) -> Iterator[pa.RecordBatch]:
    """The windows on ``share`` of the pages (host, blocks) that some chunk of them has of a host."""

    def told(pages: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        hosts, values = [], []
        for host, own in pages.items():
            window, count = np.unique(np.concatenate(own), return_counts=True)
            window = window[count >= share * len(own) - 1e-9]
            hosts += [host] * len(window)
            values.append(window)
        return pa.record_batch({"host": pa.array(hosts, pa.string()), "h": pa.array(np.concatenate([np.zeros(0, np.int64), *values]))})

    pages, held = {}, 0
    for batch in batches:
        for host, blocks in zip(batch.column("host").to_pylist(), batch.column("blocks"), strict=True):
            pages.setdefault(host, []).append(np.unique(window_hashes(blocks.as_py() or [], run)))
            held += 1
            if held == CHUNK:
                yield told(pages)
                pages, held = {}, 0
    yield told(pages)


def frequent_runs(pages: DataFrame, run: int, least: int, share: float) -> DataFrame | None:
    """``key``, ``at``, ``length``: where the pages (host, key, blocks) hold a substring that is on ``share`` of their host's pages, ``least`` at least."""
    sizes = pages.groupBy(F.col("host").alias("_host")).count().where(F.col("count") >= least).select("_host", F.greatest(F.ceil(F.col("count") * share - 1e-9), F.lit(least)).alias("need"))
    sizes = cut(sizes)
    some = pages.select("host", "blocks").mapInArrow(lambda batches: frequent_windows(batches, run, share), "host string, h long")
    some = cut(some.join(sizes, F.col("host") == F.col("_host"), "left_semi").distinct())
    proposed = some.count()
    if not proposed:
        return None
    lists = some.groupBy(F.col("host").alias("_host")).agg(F.collect_list("h").alias("hs"))  # as many as two pages' windows a chunk

    @F.arrow_udf("array<struct<at int, h long>>")
    def places(blocks: pa.Array, hs: pa.Array) -> pa.Array:
        out = []
        for b, h in zip(blocks, hs, strict=True):
            windows = window_hashes(b.as_py() or [], run)
            at = np.flatnonzero(np.isin(windows, h.values.to_numpy(zero_copy_only=False)))
            out.append([{"at": int(k), "h": int(windows[k])} for k in at])
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())])))

    met = pages.join(F.broadcast(lists) if proposed <= SENT else lists, F.col("host") == F.col("_host"))
    hits = cut(met.select("host", "key", F.explode(places.asNondeterministic()("blocks", "hs")).alias("x")).select("host", "key", "x.at", "x.h"))
    counts = hits.select("host", "key", "h").distinct().groupBy("host", "h").count().join(sizes, F.col("host") == F.col("_host"))
    found = hits.join(counts.where("count >= need").select("host", "h"), ["host", "h"], "left_semi")
    return sorted_suffixes(pages.select("host", "key", tokens().alias("w")), found, run, run)


def tokens() -> Column:
    return F.filter(F.split(F.array_join("blocks", " "), r"\s+"), lambda w: w != "")


def extract(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", run: int = 12, depth: int = 36, least: int = 10, share: float = 0.8) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every page."""
    read = parsed_pages(pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html")), "_html").drop("_html")
    host = F.coalesce(F.lower(F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    keyed = cut(read.select("_id", "_url", host.alias("host"), F.monotonically_increasing_id().alias("key"), "_page.marked", "_page.blocks"))
    runs = repeated_runs(keyed.where("not marked").select("host", "key", tokens().alias("w")), run, depth)
    inside = frequent_runs(keyed.where("marked").select("host", "key", "blocks"), run, least, share)
    if inside is not None:
        runs = runs.unionByName(inside)
    spots = runs.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("at", "length")).alias("spots"))
    spots = cut(spots)

    @F.arrow_udf("string")
    def remove(blocks: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([unique_runs(b, s) for b, s in zip(blocks.to_pylist(), at.to_pylist(), strict=True)], pa.string())

    # pages without a repeated run are not moved
    whole = keyed.join(spots, F.col("key") == F.col("k"), "left_anti") if not spots.isEmpty() else keyed
    cleaned = keyed.join(spots, F.col("key") == F.col("k")).select("_id", "_url", remove.asNondeterministic()("blocks", "spots").alias("text"))
    whole = whole.select("_id", "_url", F.array_join("blocks", " ").alias("text"))
    both = whole.unionByName(cleaned) if not spots.isEmpty() else whole
    return both.select(F.col("_id").alias(id_col), F.col("_url").alias(url), "text")
