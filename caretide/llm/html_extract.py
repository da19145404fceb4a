"""Main text of web pages by wrapper induction.

Pages of one host share a layout. Their element trees are laid over each other, elements that have the same address (signs
from the content region down, each with its place among the runs of that sign beside it) on one another; text that stands
at the same address on nearly all pages which have it is template, what varies is content. Extraction takes the article (or
main part) of a page, leaves out page furniture by element and role, and drops what its host has as template.

Every page is parsed once and counts: its elements and blocks are stored, and addresses and texts are counted natively over
all pages of a host. No host is gathered, so one with a third of all pages is spread out as any other.
"""

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from caretide.llm.common import stored
from caretide.llm.dom import content_region, parse, places

#: Text is template if at least so many pages of the host, and this share of those that have the element, hold it. Copies
#: of one page tell nothing about what varies; they count once.
LEAST_PAGES, SHARE = 4, 0.8
#: Up to so many template texts (hashes of 8 bytes) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Pages whose elements and texts a task holds at once.
PIECE = 200


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def template_texts(pages: list[str]) -> list[str]:
    """path and text (joined by a tab) of the template of one host's pages: the plain form of ``wrappers``."""
    having: Counter[str] = Counter()
    held: Counter[tuple[str, str, str]] = Counter()
    for html in set(pages):
        elements, texts = places(content_region(parse(html)))
        having.update(address for address, _ in elements)
        held.update({(*elements[i], text) for i, text in texts})
    return sorted({f"{path}\t{text}" for (address, path, text), n in held.items() if n >= max(LEAST_PAGES, SHARE * having[address])})


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), signed=True)


PARSED = "host string, page bigint, elements array<struct<at: bigint, path: bigint>>, texts array<struct<element: int, text: string>>"


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, page (hash of its html, null for none), elements of its content region (hashes of address and
    path) and its texts with the position of their element, in page order."""
    page = F.when(F.col(html).isNotNull(), F.xxhash64(html))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), page.alias("page"), F.col(html).alias("html"))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}  # addresses and paths recur from page to page

        def number(text: str) -> int:
            if (found := known.get(text)) is None:
                if len(known) >= 10_000:
                    known.clear()
                found = known[text] = _number(text)
            return found

        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                at, path, n_elements, element, text, n_texts = [], [], [0], [], [], [0]
                for value in piece.column("html"):
                    elements, texts = places(content_region(parse(value.as_py() or "")))
                    at += [number(a) for a, _ in elements]
                    path += [number(p) for _, p in elements]
                    n_elements.append(len(at))
                    element += [i for i, _ in texts]
                    text += [t for _, t in texts]
                    n_texts.append(len(text))
                columns = [piece.column(c) for c in ("page_id", "url", "host", "page")]
                pairs = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(path, pa.int64())], ["at", "path"])
                columns.append(pa.ListArray.from_arrays(pa.array(n_elements, pa.int32()), pairs))
                pairs = pa.StructArray.from_arrays([pa.array(element, pa.int32()), pa.array(text, pa.string())], ["element", "text"])
                columns.append(pa.ListArray.from_arrays(pa.array(n_texts, pa.int32()), pairs))
                yield pa.record_batch(columns, names=["page_id", "url", "host", "page", "elements", "texts"])

    return own.mapInArrow(regions, StructType(own.select("page_id", "url").schema.fields + StructType.fromDDL(PARSED).fields))


def _element(text: Column) -> Column:
    return F.get(F.col("elements"), text["element"])


def _key(text: Column) -> Column:
    return F.xxhash64(_element(text)["path"], text["text"])


def wrappers(parts: DataFrame) -> DataFrame:
    """host, template (hashes of path and text) for hosts of ``parsed`` pages that have any."""
    nodes = F.transform("elements", lambda e: F.struct(e["at"].alias("at"), F.lit(None).cast("bigint").alias("key")))
    held = F.transform("texts", lambda t: F.struct(_element(t)["at"].alias("at"), _key(t).alias("key")))
    seen = parts.filter("page IS NOT NULL").select("host", "page", F.explode(F.array_distinct(F.concat(nodes, held))).alias("e"))
    counts = seen.select("host", "page", "e.at", "e.key").distinct().groupBy("host", "at", "key").agg(F.count("*").alias("n"))
    often = stored(counts.filter(F.col("n") >= LEAST_PAGES), "counts")
    having = often.filter("key IS NULL").select("host", "at", F.col("n").alias("pages"))
    constant = often.filter("key IS NOT NULL").join(having, ["host", "at"]).filter(F.col("n") >= SHARE * F.col("pages"))
    return constant.groupBy("host").agg(F.collect_set("key").alias("template"))


def main_text(html: str, template: frozenset[str] = frozenset()) -> str:
    """Blocks of the main text, joined by an empty line."""
    elements, texts = places(content_region(parse(html)))
    return "\n\n".join(text for i, text in texts if f"{elements[i][1]}\t{text}" not in template)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars (its code points).

    Null or empty html: empty text. Null url or a url without a host: pages of the host "" share a wrapper. Repeated rows
    are extracted each. Empty table: no rows. Other columns of ``pages`` are not read.
    """
    parts = stored(parsed(pages, page_id, url, html), "parsed-pages")
    known = stored(wrappers(parts).withColumnRenamed("host", "_host"), "wrappers")
    if (known.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_KEYS:
        known = F.broadcast(known)
    joined = parts.join(known, F.col("host") == F.col("_host"), "left")
    kept = F.filter("texts", lambda t: ~F.coalesce(F.array_contains("template", _key(t)), F.lit(False)))
    out = joined.select("page_id", "url", F.array_join(kept["text"], "\n\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
