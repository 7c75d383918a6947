"""Kernels of a text and the global text around them, as column expressions linear in the braces of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.lexer import let

#: What a kernel begins with.
SPECIFIER = "kernel void"


def _body_length(chunk: Column) -> Column:
    """Characters up to where as many braces are closed as opened (one at least), with the spaces and line ends behind; all
    of them where that isn't so."""
    pieces = F.regexp_extract_all(chunk, F.lit(r"[^{}]*+(?:[{}]|\z)"), F.lit(0))  # the rest behind the last brace is a piece too, or each of its characters would scan it
    zero = F.lit(0)
    start = F.struct(zero.alias("opened"), zero.alias("closed"), zero.alias("length"), F.lit(False).alias("done"))

    def step(state: Column, piece: Column) -> Column:
        opened = state["opened"] + F.when(piece.endswith("{"), 1).otherwise(0)
        closed = state["closed"] + F.when(piece.endswith("}"), 1).otherwise(0)
        moved = F.struct(opened.alias("opened"), closed.alias("closed"), (state["length"] + F.length(piece)).alias("length"), ((opened > 0) & (opened == closed)).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    def ended(state: Column) -> Column:
        rest = F.substring(chunk, state["length"] + 1, F.length(chunk))
        return F.when(state["done"], state["length"] + F.length(rest) - F.length(F.regexp_replace(rest, "^[ \n]+", ""))).otherwise(F.length(chunk))

    return let(F.aggregate(pieces, start, step), ended)


def kernel_parts(text: Column) -> Column:
    """struct(head, parts): the text before the first kernel, and for each kernel its text and the text behind it up to the next."""

    def part(chunk: Column) -> Column:
        return let(_body_length(chunk), lambda n: F.struct(F.concat(F.lit(SPECIFIER), F.substring(chunk, F.lit(1), n)).alias("kernel"), F.substring(chunk, n + 1, F.length(chunk)).alias("behind")))

    return let(F.split(text, SPECIFIER, -1), lambda c: F.struct(F.element_at(c, 1).alias("head"), F.transform(F.slice(c, F.lit(2), F.size(c)), part).alias("parts")))


def kernels_and_headers(text: Column) -> Column:
    """Array of (kernel, header): each kernel with all global text in front of it."""

    def headers(p: Column) -> Column:
        behind = F.transform(p["parts"], lambda x: x["behind"])
        return F.transform(p["parts"], lambda x, i: F.struct(x["kernel"].alias("kernel"), F.concat(p["head"], F.array_join(F.slice(behind, F.lit(1), i), "")).alias("header")))

    return let(kernel_parts(text), headers)


def kernels_with_globals(text: Column) -> Column:
    """Array of kernels, each behind all global text in front of it."""
    return F.transform(kernels_and_headers(text), lambda x: F.concat(x["header"], x["kernel"]))


def kernels_only(text: Column) -> Column:
    return F.transform(kernel_parts(text)["parts"], lambda x: x["kernel"])
