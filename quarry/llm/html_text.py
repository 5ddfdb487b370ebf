"""Main text of HTML pages by site template removal.

Every element of a page is hashed with all it holds. Spark counts the hashes by host over pages of distinct text, and
elements that recur go with all they hold: those on max(MIN_PAGES, log2(pages + 1)) distinct pages, which hardly grows
with the host. Inside articles the place must be the same too, counted from either end, or else the element must be on
SHARE of the pages; paragraphs and headings go there with a recurring element around them only, not by themselves: pages
may share passages. A page on which an element is most of the text is no evidence for it.

Only what that leaves is judged by its kind, which is all there is for hosts of few pages: menus, footers, adverts, forms
and the like go by tags and roles; a name (class or id) kills an element unless that holds the page's only articles or
most of its prose. n_template and n_rules count the blocks that went either way. Of what is left, articles are taken, else
main elements, else all blocks that aren't mostly links. Where at most a tenth of that text would be left, blocks that
recur on at most half as many pages as the page's commonest are content and stay; where there are none, all stay.

Pages are parsed twice, to count and to delete, so that no text is stored or shuffled while the templates, one number
each, fit a broadcast of MOST_TEMPLATES; beyond that pages are joined with their own templates.

Near copies under several URLs count as pages each; the last rule alone protects them, so that on a host of little else
only what differs between them is left.

Cases: null html is an empty page, with empty text. A null url is a host of its own. Equal rows get equal results. An
empty table gives an empty result. Clashing columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.html_blocks import LINKED, Block, parse
from quarry.session import ship, stored

MIN_PAGES, SHARE, LINK_SHARE = 3, 0.5, LINKED
#: Share of the text that removal of templates must leave; templates that are broadcast, 12 bytes each.
LEAST_LEFT, MOST_TEMPLATES = 0.1, 1 << 20
STEP = 256
KEYS = pa.schema([("host", pa.int64()), ("content", pa.int64()), ("keys", pa.list_(pa.int64()))])
TEXTS = "page_id long, url string, host string, text string, n_chars long, n_blocks long, n_template long, n_rules long"
ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in TEXTS.split(", ")])


def digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, keys) of pages (host, html): hashes of the host and of the live text, and the keys that are evidence."""
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            rows = []
            for host, html in zip(batch.column(0).slice(a, STEP).to_pylist(), batch.column(1).slice(a, STEP), strict=True):
                page = parse(html.as_py() or "")
                page.judge_names()
                seed = (host or "").encode()
                keys, most = page.keys(seed)
                live = "\n".join(b.text for b in page.blocks if not b.dead)
                rows.append({"host": digest(seed), "content": digest(live.encode(errors="surrogatepass")), "keys": sorted({k for ks in keys.values() for k in ks} - most)})
            yield pa.RecordBatch.from_pylist(rows, schema=KEYS)


def taken(blocks: list[tuple[Block, int]], link_share: float) -> list[Block]:
    """The blocks that are the main text, of live blocks with the times their commonest element recurs."""
    region = next(([x for x in blocks if on(x[0])] for on in (lambda b: b.article, lambda b: b.main) if any(on(b) for b, _ in blocks)), None)
    if region is None:
        region = [x for x in blocks if x[0].links < link_share]
    chars = lambda xs: sum(len(b.text) for b, _ in xs)
    left = [x for x in region if not x[1]]
    if chars(left) <= chars(region) * LEAST_LEFT:
        top = max((n for _, n in blocks), default=0)
        left = [x for x in region if 2 * x[1] <= top] or region
    return [b for b, _ in left]


def extract(batches: Iterator[pa.RecordBatch], link_share: float, table=None) -> Iterator[pa.RecordBatch]:
    """Texts of pages (page_id, url, host, html, hits): templates from a broadcast of sorted keys and numbers, or from hits."""
    if table is not None:
        keys, times = table.value

        def known(wanted: list[int]) -> Callable[[int], int]:
            w = np.array(wanted, np.int64)
            at = np.minimum(np.searchsorted(keys, w), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
            found = dict(zip(wanted, np.where(keys[at] == w, times[at], 0).tolist(), strict=True)) if len(keys) else {}
            return lambda k: found.get(k, 0)

    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part = batch.slice(a, STEP)
            rows = []
            for page_id, url, host, hits, html in zip(*(part.column(i).to_pylist() for i in (0, 1, 2)), part.column(4).to_pylist() if table is None else [None] * part.num_rows, part.column(3), strict=True):
                page = parse(html.as_py() or "")
                page.judge_names()
                own, _ = page.keys((host or "").encode())
                number = known([k for ks in own.values() for k in ks]) if table is not None else partial(lambda k, d: d.get(k, 0), d={x["h"]: x["n"] for x in hits or ()})
                around: dict = {}
                for e in page.elements:
                    around[e] = max((number(k) for k in own.get(e, ())), default=0)
                    if e.up:
                        around[e] = max(around[e], around[e.up])
                live = [(b, around[b.at]) for b in page.blocks if not b.dead]
                chosen = taken(live, link_share)
                text = "\n".join(b.text for b in chosen)
                stays = set(map(id, chosen))
                template = sum(around[b.at] > 0 and id(b) not in stays for b in page.blocks)
                rules = sum(b.dead and not around[b.at] for b in page.blocks)
                rows.append({"page_id": page_id, "url": url, "host": host, "text": text, "n_chars": len(text), "n_blocks": len(page.blocks), "n_template": template, "n_rules": rules})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def host(url):
    """Host of a URL, in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(h, n): keys that recur on pages (host, html) of a host, which is part of each key, with the number of distinct pages."""
    found = stored(pages.select("host", "html").mapInArrow(count, "host long, content long, keys array<long>"), "page-keys")
    # copies of a page count once
    own = found.groupBy("host", "content").agg(F.min("keys").alias("keys"))
    sizes = own.groupBy("host").agg(F.count("*").alias("pages"))
    many = own.select("host", F.explode("keys").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    need = F.greatest(F.lit(min_pages), F.ceil(F.log2(F.col("pages") + 1)))
    many = many.join(sizes, "host").where((F.col("n") >= need) & ((F.col("h") % 2 == 0) | (F.col("n") >= F.col("pages") * share)))
    return stored(many.groupBy("h").agg(F.max("n").alias("n")), "page-templates")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, link_share: float = LINK_SHARE, most_templates: int = MOST_TEMPLATES) -> DataFrame:
    """(page_id, url, host, text, n_chars, n_blocks, n_template, n_rules) of each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    many = templates(pages, min_pages, share)
    if many.count() <= most_templates:
        got = many.orderBy("h").toArrow()  # at most 16 bytes for each of most_templates
        table = spark.sparkContext.broadcast((got.column(0).to_numpy(), got.column(1).to_numpy().astype(np.int32)))
        return pages.mapInArrow(partial(extract, link_share=link_share, table=table), TEXTS)
    # pages of one host, address and content have the same templates: these meet the page by a hash of all three
    row = [F.xxhash64("host", "url", "html").alias("k1"), F.xxhash64(F.lit("again"), "html", "url").alias("k2")]
    each = pages.select(*row, "host", "html").mapInArrow(own_keys, "k1 long, k2 long, h long").distinct()
    hits = each.join(many, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "n")).alias("hits"))
    both = pages.select("*", *row).join(hits, ["k1", "k2"], "left").select("page_id", "url", "host", "html", "hits")
    return both.mapInArrow(partial(extract, link_share=link_share), TEXTS)


def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, h): the keys of pages (k1, k2, host, html)."""
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part, out = batch.slice(a, STEP), ([], [], [])
            for k1, k2, host_, html in zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3), strict=True):
                page = parse(html.as_py() or "")
                page.judge_names()
                keys = sorted({k for ks in page.keys((host_ or "").encode())[0].values() for k in ks})
                for column, values in zip(out, ([k1] * len(keys), [k2] * len(keys), keys), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["k1", "k2", "h"])


def op1_template_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
