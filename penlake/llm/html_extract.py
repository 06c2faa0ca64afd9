"""Main text of web pages: a suffix array per host tells which regions of its pages are boilerplate.

1. A page's markup is read into blocks. Each lies in a region, named by the containers around it (``div.ad``,
   ``article``, ``nav/ul``), and structure marks what HTML itself says: elements that are never main text (``nav``,
   ``footer``, forms, hidden elements, an article inside an article), and the main container.
2. The token streams of a host's pages are laid end to end, and the suffixes are brought into order by their first
   ``run`` tokens (a suffix array cut at that depth, which is all that shows whether a position starts a long repeat);
   neighbours in that order that come from two distinct pages are a repeated run. Every position of every page takes
   part. The array is spread over buckets of suffixes (see packed.py), so a host with a third of the pages is no large
   group. Pages are read twice, here and for the result, so no copy of them is written; only those without a main
   container go along with their positions.
3. For each host and region the share of repeated positions, shrunk to that of the region over all hosts, is held
   against the host's own: a region with ``odds`` times the host's odds is boilerplate there, on every page; one with
   no more than the host's odds is content.
4. A page keeps the blocks of its main container (of several articles the longest) but for nested containers that are
   boilerplate. Without a main container it keeps what isn't boilerplate: content regions whole, and of undecided ones
   the tokens that no repeated run covers.

Blocks are joined by line feeds, white space inside them is one blank, character references are decoded.

Defined results: a null or empty html gives an empty text; rows that repeat a page_id are one page when pages are
counted, and so are all rows without one; a null url is a host of its own; of articles that tie in length the first
is the main one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import WordHashes, join_checked, materialise, mixed
from penlake.llm.packed import ROW, batch_of, by_bucket, freeze, joined_up, parcels, squeeze, thaw, unsqueeze
from penlake.llm.substring_dedup import Powers, bucket_of, firsts

U64, I64, I32, U8 = np.uint64, np.int64, np.int32, np.uint8
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page, read up to their end tag.
RAW = frozenset("script style noscript template title textarea iframe svg canvas audio video select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr "
    "math mi mn mo mrow ms mspace mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded semantics annotation".split()
)
CONTAINERS = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Whole class names and ids that say what a container is (fixed values); a guard for what repeats don't show, such as reader comments.
BOILER_NAMES = frozenset(
    "ad ads advert advertisement adsbygoogle breadcrumb breadcrumbs comment-list comment-respond comments comments-area cookie-banner cookie-consent cookie-notice newsletter-signup "
    "page-footer page-header pagination share-buttons sidebar site-footer site-header site-nav skip-link social-share".split()
)
CONTENT_NAMES = frozenset("article-body article-content articlebody entry-content main-content maincontent page-content post-body post-content story-body".split())
BOILER, OPEN, MAIN, CONTENT, NAMED = 0, 1, 2, 3, 4
INSIDE = "page_id long, url string, host string, outer string, blocks array<struct<text:string,region:string>>"
INSIDE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("outer", pa.string()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("region", pa.string())])))])
RESULT = "page_id long, url string, text string, n_chars long"
RESULT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
#: Positions for which a region's or a host's own share counts as much as the shared one; least repeated positions, and least positions, for a verdict.
SHRINK, LEAST_REPEATED, LEAST_SEEN = 200, 10, 1000
#: Positions that a task brings into order at a time, and the bits of a hash that are compared within a bucket: of some two
#: million positions there, at any size of the input, so one in ten million is taken for another's repeat.
TOGETHER, LOW = 4_000_000, U64((1 << 44) - 1)


def zone_of(tag: str, a: dict[str, str], around: int) -> int:
    """The zone that an element opens inside the zone around it."""
    if around == BOILER or tag in BOILER_TAGS:
        return BOILER
    if tag in ("html", "body"):
        return around
    inside = around in (MAIN, CONTENT)
    if tag == "header" and not inside:
        return BOILER
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return BOILER
    role = a.get("role", "").lower()
    if role in BOILER_ROLES and not (role == "banner" and inside):
        return BOILER
    if tag == "article":
        return BOILER if around == MAIN else MAIN  # an article inside an article is a reader's comment
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if around == NAMED or (tag != "main" and BOILER_NAMES.intersection(names)):
        return NAMED
    if not inside and (tag == "main" or role == "main" or a.get("itemprop", "").lower() == "articlebody" or CONTENT_NAMES.intersection(names)):
        return CONTENT
    return around


def region_of(tag: str, a: dict[str, str], around: str) -> str:
    """The name of the region that an element opens: its tag and classes (or id) under those around, numbers left out."""
    if tag not in CONTAINERS:
        return around
    names = re.sub(r"[0-9]+", "", a.get("class") or a.get("id") or "").lower().split()
    own = ".".join([tag, *sorted(set(names))])
    return f"{around}/{own}" if around else own


def blocks_of(html: str) -> list[tuple[str, int, str, int]]:
    """Blocks of a page in order: text, zone, region, and the number of the main container they're in (0 for none)."""
    out: list[tuple[str, int, str, int]] = []
    text: list[str] = []
    stack: list[tuple] = []  # open elements that are not inline, with what was around them
    zone, region, unit, units, at, size = OPEN, "", 0, 0, 0, len(html)

    def close() -> None:
        if text and (block := " ".join("".join(text).split())):
            out.append((block, zone, region, unit))
        text.clear()

    while at < size:
        m = TAG.search(html, at)
        if m is None:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                # A span or link may have opened a zone of its own.
                if not (stack and stack[-1][0] == tag):
                    if tag in ("td", "th"):
                        text.append(" ")
                    continue
            elif tag == "p" and not any(x[0] == "p" for x in stack):
                close()
                continue
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    _, zone, region, unit = stack[i]
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            if tag not in ("button", "select"):
                text.append(" ")
            continue
        a = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in ATTRIBUTE.finditer(m[3])} if m[3].strip(" /") else {}
        if tag in INLINE:
            if tag in ("br", "td", "th"):
                text.append(" ")
            elif a and zone != BOILER and (inner := zone_of(tag, a, zone)) in (BOILER, NAMED) and inner != zone and not m[3].rstrip().endswith("/"):
                close()
                stack.append((tag, zone, region, unit))
                zone = inner
            continue
        close()
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if stack and stack[-1][0] == "p":  # a new block ends an open paragraph
            _, zone, region, unit = stack.pop()
        stack.append((tag, zone, region, unit))
        inner = zone_of(tag, a, zone)
        if inner in (MAIN, CONTENT) and inner != zone:
            units += 1
            unit = units
        zone, region = inner, region_of(tag, a, region)
    close()
    return out


def main_unit(blocks: list[tuple[str, int, str, int]]) -> int | None:
    """The main container: the longest article, else the longest of what is marked as content; None if there's neither."""
    for kind in (MAIN, CONTENT):
        sizes: dict[int, int] = {}
        for t, z, _, u in blocks:
            if z == kind:
                sizes[u] = sizes.get(u, 0) + len(t)
        if sizes:
            return max(sizes, key=lambda u: (sizes[u], -u))
    return None


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def verdicts(stats: DataFrame, odds: float = 3.0) -> DataFrame:
    """host, region and boiler (true: boilerplate, false: content) of the regions that the array decides.

    stats: host, region, n (positions) and repeated (those whose run comes on another page of the host too). The
    share of a region is shrunk to its share over all hosts, that of a host to that of all pages.
    """
    total = stats.agg(F.sum("repeated").alias("r"), F.sum("n").alias("n")).first()
    overall = (total["r"] or 0) / max(total["n"] or 0, 1)
    by_region = stats.groupBy("region").agg(F.sum("repeated").alias("all_repeated"), (F.sum("repeated") / F.sum("n")).alias("pooled"))
    by_host = stats.groupBy("host").agg(((F.sum("repeated") + SHRINK * F.lit(overall)) / (F.sum("n") + SHRINK)).alias("base"))
    share = (F.col("repeated") + SHRINK * F.col("pooled")) / (F.col("n") + SHRINK)
    joined = stats.join(by_region, "region").join(by_host, "host").withColumn("share", share)
    ratio = F.col("share") * (1 - F.col("base")) / F.greatest(F.col("base") * (1 - F.col("share")), F.lit(1e-12))
    boiler = F.when((ratio >= odds) & (F.col("all_repeated") >= LEAST_REPEATED), F.lit(True)).when((ratio <= 1) & (F.col("n") >= LEAST_SEEN), F.lit(False))
    return joined.select("host", "region", "n", "repeated", "share", "base", boiler.alias("boiler")).where("boiler is not null")


def kept_blocks(blocks: list[dict], main: int | None, off: set[str]) -> list[dict]:
    """The blocks that structure and the host's verdicts leave; of a main container, those nested in a boilerplate container go."""
    inner = [b for b in blocks if b["zone"] not in (BOILER, NAMED)]
    if main is None:
        return [b for b in inner if b["region"] not in off]
    inner = [b for b in inner if b["unit"] == main]
    outer = outermost(inner)
    return [b for b in inner if b["region"] not in off or b["region"] == outer]


def outermost(blocks: list[dict]) -> str:
    """The region of a main container's blocks that lies in the fewest others."""
    return min((b["region"] for b in blocks), key=lambda r: r.count("/"), default="")


def extract(pages: DataFrame, run: int = 6, bucket_pages: int = 4000) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // bucket_pages))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str, int | None, list[dict]]]:
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                blocks = blocks_of(html)
                yield page_id, url, f"host {host_of(url)}" if url is not None else f"page {page_id}", main_unit(blocks), [dict(zip(("text", "zone", "region", "unit"), x)) for x in blocks]

    def row_key(page_id: int | None, url: str | None, blocks: list[dict]) -> int:
        return xxhash.xxh3_64_intdigest(repr((page_id, url, blocks)).encode())

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions to bring into order (kind 0), those of open pages settled here (1), open pages (2), and counts by host and region: all (9), repeated (8)."""
        import json

        word, powers = WordHashes(), Powers()
        hs, page, row, at, code, seen, rows, size = [], [], [], [], [], {}, [], 0
        for page_id, url, host, main, blocks in parsed(batches):
            key = row_key(page_id, url, blocks) if main is None else 0
            if main is None:
                k = np.array([key], U64)
                rows.append((int(bucket_of(k, n)[0]), 2, int(k.view(I64)[0]), host.encode(), squeeze(json.dumps((page_id, url, blocks)).encode())))
                size += sum(len(x["text"]) for x in blocks) // 8
            words = [x["text"].encode().split() for x in blocks]
            tokens = word([w for some in words for w in some])
            if len(tokens) >= run:
                g = powers.runs(tokens, run)
                codes = {x["region"]: xxhash.xxh3_64_intdigest(f"{host}\n{x['region']}".encode()) >> 24 for x in blocks}
                own = np.repeat(np.array([codes[x["region"]] for x in blocks], U64), [len(w) for w in words])[: len(g)]
                for region, c in codes.items():
                    seen.setdefault(c, [host, region, 0])[2] += int((own == U64(c)).sum())
                hs.append(mixed(g ^ U64(xxhash.xxh3_64_intdigest(host.encode()))))
                page.append(np.full(len(g), -1 if page_id is None else page_id, I64))
                row.append(np.full(len(g), key, U64))
                at.append(np.arange(len(g), dtype=I32) if main is None else np.zeros(len(g), I32))
                code.append(own)
                size += len(g)
            if size >= TOGETHER:
                yield batch_of(rows + facts(seen, *map(np.concatenate, (hs, page, row, at, code))) if hs else rows)
                hs, page, row, at, code, seen, rows, size = [], [], [], [], [], {}, [], 0
        if hs or rows:
            yield batch_of(rows + facts(seen, *map(np.concatenate, (hs, page, row, at, code))) if hs else rows)

    def facts(seen: dict[int, list], h: np.ndarray, page: np.ndarray, row: np.ndarray, at: np.ndarray, code: np.ndarray) -> list[tuple]:
        order, first = firsts(h, page, at)
        other = page[order] != page[order[first]]
        many = np.bincount(first, other, len(first))[first] > 0
        lead = np.concatenate([[True], np.diff(page[order]) != 0]) | (first == np.arange(len(first)))
        two = lead & (np.cumsum(lead) - np.cumsum(lead)[first] < 2)  # one place on each of two pages speaks for a run that's known to repeat
        send = np.sort(order[~many | two])
        known = np.zeros(len(h), U8)
        known[order[many]] = 1
        bucket = bucket_of(h[send], n)
        by = np.argsort(bucket, kind="stable")
        send, bucket, rows = send[by], bucket[by], []
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for i, some in zip(cuts.tolist(), np.split(send, cuts[1:])):
            if len(some):
                names, which = np.unique(code[some], return_inverse=True)  # a few regions: their numbers take less room
                rows.append((int(bucket[i]), 0, None, freeze(h[some] & LOW, page[some], row[some], at[some], which.astype(I32), known[some]), freeze(names)))
        told = np.flatnonzero((known == 1) & (row != 0))
        rows += parcels(1, bucket_of(row[told], n), row[told], at[told])
        rows += [(spread(c), 9, c, f"{host}\n{region}".encode(), k.to_bytes(8, "big")) for c, (host, region, k) in seen.items()]
        return rows + counted(code[known == 1])

    def counted(code: np.ndarray) -> list[tuple]:
        return [(spread(c), 8, c, None, k.to_bytes(8, "big")) for c, k in zip(*(x.tolist() for x in np.unique(code, return_counts=True)))]

    def spread(code: int) -> int:
        return int(bucket_of(np.array([code], U64), n)[0])

    def repeated(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        passed = [(bucket, k, *r) for k in (1, 2, 8, 9) for r in kinds.get(k, [])]
        if 0 not in kinds:
            if passed:
                yield batch_of(passed)
            return
        h, page, row, at, which, known = joined_up(kinds[0], U64, I64, U64, I32, I32, U8)
        names = [thaw(data, U64)[0] for *_, data in kinds[0]]
        sizes = [int.from_bytes(meta[:4], "little") for _, meta, _ in kinds[0]]
        code = np.concatenate([x[which[z - k : z]] for x, k, z in zip(names, sizes, np.cumsum(sizes))])
        order, first = firsts(h, page, at)
        other = page[order] != page[order[first]]
        hit = order[(np.bincount(first, other, len(first))[first] > 0) & (known[order] == 0)]
        rows = passed + counted(code[hit])
        hit = hit[row[hit] != 0]
        rows += parcels(1, bucket_of(row[hit], n), row[hit], at[hit])
        if rows:
            yield batch_of(rows)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pages with a main container the blocks that structure leaves, and the region that stays whatever the verdicts say."""
        rows = []
        for page_id, url, host, main, blocks in parsed(batches):
            if main is not None:
                left = kept_blocks(blocks, main, set())
                rows.append((page_id, url, host, outermost(left), [{"text": x["text"], "region": x["region"]} for x in left]))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INSIDE_ARROW.types)], schema=INSIDE_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INSIDE_ARROW.types)], schema=INSIDE_ARROW)

    def cleaned(bucket: int, kinds: dict) -> Iterator[pa.RecordBatch]:
        import json

        row, at = joined_up(kinds.get(1, []), U64, I32)
        order = np.argsort(row, kind="stable")
        row, at = row[order], at[order]
        out = []
        for key, verdict, data in kinds.get(2, []):
            page_id, url, blocks = json.loads(unsqueeze(data))
            off, on = json.loads(verdict) if verdict else ((), ())
            key = np.array([key], I64).view(U64)[0]
            starts = at[np.searchsorted(row, key) : np.searchsorted(row, key, "right")]
            text = "\n".join(unique_runs(blocks, starts, run, set(off), set(on)))
            out.append((page_id, url, text, len(text)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RESULT_ARROW.types)], schema=RESULT_ARROW)

    found = materialise(by_bucket(slim.mapInArrow(suffixes, ROW), repeated, ROW), "repeats")
    k = F.conv(F.hex("data"), 16, 10).cast("long")
    counts = found.where("kind in (8, 9)").groupBy("id").agg(
        F.sum(F.when(F.col("kind") == 9, k).otherwise(0)).alias("n"), F.sum(F.when(F.col("kind") == 8, k).otherwise(0)).alias("repeated"), F.max(F.decode("meta", "UTF-8")).alias("name"),
    )
    stats = materialise(counts.where("n > 0").select(F.split("name", "\n")[0].alias("host"), F.split("name", "\n")[1].alias("region"), "n", "repeated"), "regions")
    decided = verdicts(stats)
    some = lambda x: F.collect_set(F.when(x, F.col("region")))
    by_host = materialise(decided.groupBy("host").agg(some(F.col("boiler")).alias("off"), some(~F.col("boiler")).alias("on")), "verdicts")
    settled = join_checked(slim.mapInArrow(inside, INSIDE), by_host, "host", "left")
    stays = lambda x: (x["region"] == F.col("outer")) | ~F.array_contains(F.coalesce("off", F.array().cast("array<string>")), x["region"])
    settled = settled.select("page_id", "url", F.array_join(F.transform(F.filter("blocks", stays), lambda x: x["text"]), "\n").alias("text"))
    settled = settled.withColumn("n_chars", F.length("text").cast("long"))
    rest = join_checked(found.where("kind = 2").withColumn("host", F.decode("meta", "UTF-8")), by_host, "host", "left")
    verdict = F.when(F.col("off").isNotNull(), F.to_json(F.array("off", "on")).cast("binary"))
    rest = rest.select("bucket", "kind", "id", verdict.alias("meta"), "data")
    return settled.unionByName(by_bucket(found.where("kind = 1").unionByName(rest), cleaned, RESULT))


def unique_runs(blocks: list[dict], starts: np.ndarray, run: int, off: set[str], on: set[str]) -> list[str]:
    """The kept blocks of a page without a main container, those of undecided regions without the tokens that repeated runs cover."""
    sizes = [len(x["text"].encode().split()) for x in blocks]
    covered = np.zeros(sum(sizes) + 1, I64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + run, len(covered) - 1), -1)
    covered = np.cumsum(covered) > 0
    keep = {id(x) for x in kept_blocks(blocks, None, off)}
    out, at = [], 0
    for x, k in zip(blocks, sizes):
        if id(x) in keep:
            hit = covered[at : at + k]
            if x["region"] in on or not hit.any():
                out.append(x["text"])
            elif not hit.all():
                out.append(" ".join(w.decode() for w, c in zip(x["text"].encode().split(), hit) if not c))
        at += k
    return out
