"""Positions of pattern matches as DataFrame expressions.

Each match is put between two marks, the marked text is split at the first, and a fold over the pieces adds up their
lengths. Pieces are folded in chunks, each with a list of its own, so that a text with very many matches takes no more time for
each. Offsets count code points; ends are exclusive. Patterns must not match control characters.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

OPEN, CLOSE = "\u0001", "\u0002"
#: Characters before and after a match that are kept as its context.
CONTEXT = 40
#: Pieces in a chunk.
CHUNK = 128

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,before:string,after:string>"


def find(
    text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column], need: Column, inside: bool = False
) -> Column:
    """Leftmost non-overlapping matches that pass ``keep``, as an array of spans. ``need`` is a cheap condition that every
    text with a match meets; other texts are not searched.

    Matches are told apart before ``keep`` sees them, so one that fails hides others that start in it. With ``inside`` it
    hides none: a copy of each match is put before its place, and those that pass and don't overlap are taken. Such patterns
    have no groups.
    """
    plain = F.translate(text, OPEN + CLOSE, "\u0003\u0003")
    if inside:
        pieces = F.split(F.regexp_replace(plain, f"(?=({pattern}))", f"{OPEN}$1{CLOSE}"), OPEN)
    else:
        pieces = F.split(F.regexp_replace(plain, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.lit("").alias("tail"),
        F.lit(0).cast("long").alias("free"),
        F.array().cast(f"array<array<{SPAN}>>").alias("chunks"),
    )

    def span(state: Column, value: Column, behind: Column) -> Column:
        return F.struct(
            state["at"].alias("start"),
            F.lit(rank).alias("rank"),
            (state["at"] + F.length(value)).alias("end"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
            state["tail"].alias("before"),
            F.substring(behind, 1, CONTEXT).alias("after"),
        )

    def step_inside(state: Column, piece: Column) -> Column:
        split = F.instr(piece, CLOSE)
        value = F.when(split > 0, F.substring_index(piece, CLOSE, 1))
        rest = F.substring_index(piece, CLOSE, -1)  # with the match itself
        behind = F.substring(rest, F.length(value) + 1, F.length(rest))
        kept = F.when(split > 0, (state["free"] <= state["at"]) & keep(value)).otherwise(False)
        return F.struct(
            (state["at"] + F.length(rest)).alias("at"),
            F.right(F.when(kept, behind).otherwise(F.concat(state["tail"], rest)), F.lit(CONTEXT)).alias("tail"),
            F.when(kept, state["at"] + F.length(value)).otherwise(state["free"]).alias("free"),
            F.when(kept, F.concat(state["found"], F.array(span(state, value, behind)))).otherwise(state["found"]).alias("found"),
        )

    def step(state: Column, piece: Column) -> Column:
        split = F.instr(piece, CLOSE)
        value = F.when(split > 0, F.substring_index(piece, CLOSE, 1))
        rest = F.substring_index(piece, CLOSE, -1)
        return F.struct(
            (state["at"] + F.length(piece) - F.when(split > 0, 1).otherwise(0)).alias("at"),
            F.right(rest, F.lit(CONTEXT)).alias("tail"),
            state["free"].alias("free"),
            F.when((split > 0) & keep(value), F.concat(state["found"], F.array(span(state, value, rest))))
            .otherwise(state["found"])
            .alias("found"),
        )

    def fold(state: Column, chunk: Column) -> Column:
        begun = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), state["free"].alias("free"), empty.alias("found"))

        def ended(inner: Column) -> Column:
            chunks = F.concat(state["chunks"], F.array(inner["found"]))
            return F.struct(inner["at"].alias("at"), inner["tail"].alias("tail"), inner["free"].alias("free"), chunks.alias("chunks"))

        return F.aggregate(chunk, begun, step_inside if inside else step, ended)

    def cut(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int"))
        return F.transform(numbers, lambda number: F.slice(whole, number * CHUNK + 1, F.lit(CHUNK)))

    # The array of one array makes Spark split the text once, not for each chunk.
    chunks = F.get(F.transform(F.array(pieces), cut), F.lit(0))
    found = F.aggregate(chunks, start, fold, lambda state: F.flatten(state["chunks"]))
    return F.when(need, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def in_order(*spans: Column) -> Column:
    """By start, then by the rank of the kind."""
    return F.array_sort(F.concat(*spans))
