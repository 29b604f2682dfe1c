"""Chunks of documents, as one fold in the row: paragraphs, cut where they are too long, packed up to a size.

The text is split at blank lines. A fold over its paragraphs keeps how far it has come, the open chunk and the closed ones;
a paragraph is fed to it in slices of SLICE characters, so that a cut looks at a slice and not at all that is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from .windows import let

TARGET, LEAST, MOST = 1200, 200, 2000
#: Characters of a paragraph that are looked at together, in pieces of the largest size.
SLICE = 2

#: White space, blank lines between paragraphs, and after what an over-long paragraph is cut, best first.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK_LINE = r"\n[ \t]*\n"
CUTS = ("[.!?]", "[;:]", ",", "")

SPAN = "struct<s:int,e:int>"


def _left(t: Column) -> Column:
    return F.ltrim(t, F.lit(SPACES))


def _strip(t: Column) -> Column:
    return F.trim(t, F.lit(SPACES))


def _added(state: Column, start: Column, end: Column, target: int, least: int, most: int) -> tuple[Column, Column]:
    """(open, closed) after a unit: the open chunk grows while it stays within target, or up to most while it is short."""
    unit = F.struct(start.alias("s"), end.alias("e")).cast(SPAN)
    grown, size = end - state["open"]["s"], state["open"]["e"] - state["open"]["s"]
    fits = (grown <= target) | ((size < least) & (grown <= most))
    first = state["open"].isNull()
    now = F.when(fits, F.struct(state["open"]["s"].alias("s"), end.alias("e")).cast(SPAN)).otherwise(unit)
    closed = F.when(first | fits, state["closed"]).otherwise(F.concat(state["closed"], F.array(state["open"])))
    return now, closed  # with nothing open, fits is null


def _cut(window: Column, most: int) -> Column:
    """Where to cut so many characters: after the last white space behind the best sign that is there, or at their end."""
    places = [F.length(F.regexp_extract(window, f"^(?s:.*){sign}{SPACE}+", 0)) for sign in CUTS]
    return reduce(lambda rest, place: let(place, lambda n: F.when(n > 0, n).otherwise(rest)), reversed(places), F.lit(most))


def chunk_spans(text: Column, target: int = TARGET, least: int = LEAST, most: int = MOST) -> Column:
    """Spans (s, e) of the chunks of a text: paragraphs, cut where they exceed most, packed up to target (a chunk below least
    may grow up to most), the last one folded into the one before if it is short and fits. A null or blank text has none."""
    if not 0 < target <= most or least < 0 or least > target:
        raise ValueError("sizes must rise from least over target to most")
    parts = F.split(text, BLANK_LINE)
    gaps = F.regexp_extract_all(text, F.lit(f"({BLANK_LINE})"), F.lit(1))
    paragraphs = F.zip_with(parts, gaps, lambda p, g: F.struct(p.alias("p"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    kind = f"struct<at:int,open:{SPAN},closed:array<{SPAN}>,rest:string,pos:int>"
    shape = lambda at, opened, closed, rest, pos: F.struct(at.alias("at"), opened.alias("open"), closed.alias("closed"), rest.alias("rest"), pos.alias("pos")).cast(kind)
    start = shape(F.lit(0), F.lit(None), F.array(), F.lit(""), F.lit(0))

    def unit(state: Column, n: Column) -> Column:
        """The first n characters of what is left of a paragraph become a unit; what follows begins after white space."""
        opened, closed = _added(state, state["pos"], state["pos"] + n, target, least, most)
        tail = F.substring(state["rest"], n + 1, F.length(state["rest"]))
        return let(F.struct(tail.alias("t"), _left(tail).alias("r")), lambda x: shape(state["at"], opened, closed, x["r"], state["pos"] + n + F.length(x["t"]) - F.length(x["r"])))

    def cut_once(state: Column, _: Column) -> Column:
        return F.when(F.length(state["rest"]) > most, let(_cut(F.substring(state["rest"], 1, most), most), lambda n: unit(state, n))).otherwise(state)

    def feed(state: Column, piece: Column) -> Column:
        """A slice more of a paragraph, and every cut that what is there decides."""
        fresh = let(_left(piece), lambda r: shape(state["at"], state["open"], state["closed"], r, state["pos"] + F.length(piece) - F.length(r)))
        more = shape(state["at"], state["open"], state["closed"], F.concat(state["rest"], piece), state["pos"])
        joined = F.when(state["rest"] == "", fresh).otherwise(more)
        # one sign after the other may leave a short piece before most characters without a sign
        turns = lambda s: F.when(F.length(s["rest"]) > most, F.sequence(F.lit(1), (len(CUTS) + 1) * (F.ceil(F.length(s["rest"]) / most) + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return let(joined, lambda s: F.aggregate(turns(s), s, cut_once))

    def paragraph(state: Column, p: Column) -> Column:
        size = SLICE * most
        slices = lambda body: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(body) / size).cast("int") - 1, F.lit(0))), lambda k: F.substring(body, k * size + 1, F.lit(size)))
        begun = let(F.length(p["p"]) - F.length(_left(p["p"])), lambda n: shape(state["at"], state["open"], state["closed"], F.lit(""), state["at"] + n))
        fed = F.aggregate(slices(_strip(p["p"])), begun, feed)
        ended = let(fed, lambda s: F.when(s["rest"] == "", s).otherwise(unit(s, F.length(s["rest"]))))
        return let(ended, lambda s: shape(state["at"] + F.length(p["p"]) + p["gap"], s["open"], s["closed"], F.lit(""), F.lit(0)))

    def finish(state: Column) -> Column:
        last, before = state["open"], F.get(state["closed"], F.size(state["closed"]) - 1)
        folded = F.struct(before["s"].alias("s"), last["e"].alias("e")).cast(SPAN)
        short = (last["e"] - last["s"] < least) & (last["e"] - before["s"] <= most)
        head = F.slice(state["closed"], 1, F.greatest(F.size(state["closed"]) - 1, F.lit(0)))
        return (
            F.when(last.isNull(), state["closed"])
            .when((F.size(state["closed"]) > 0) & short, F.concat(head, F.array(folded)))
            .otherwise(F.concat(state["closed"], F.array(last)))
        )

    return F.when(text.isNotNull(), F.aggregate(paragraphs, start, paragraph, finish))


def chunk_documents(docs: DataFrame, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """document_id, text -> id, document_id, index, char_start, char_end, text: a row a chunk, see chunk_spans(). A repeated
    document_id has chunks of each of its texts, under the same ids."""
    rows = docs.select(F.col("document_id").cast("string").alias("document_id"), "text", F.posexplode(chunk_spans(F.col("text"), target, least, most)).alias("index", "x"))
    part = F.substring("text", F.col("x.s") + 1, F.col("x.e") - F.col("x.s"))
    return rows.select(chunk_id(F.col("document_id"), F.col("index")).alias("id"), "document_id", "index", F.col("x.s").alias("char_start"), F.col("x.e").alias("char_end"), part.alias("text"))
