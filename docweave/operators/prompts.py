"""Prompts fitted to a model's context: schema text, number of blocks and their characters, chosen by sizes before anything is rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as X

#: Most blocks, characters of a block from wide to narrow, and those of a column's description and instruction, wide schemas and others.
BLOCKS, CHARS = 12, (700, 500, 400, 300, 250, 200, 160, 120)
TRIMS = ((None, None), (220, 280), (160, 200), (120, 150), (80, 100), (50, 70))
TIGHT = ((160, 190), (120, 150), (80, 100), (50, 70), (40, 55))
WIDE_SCHEMA, SMALL_CONTEXT = 22, 8192


def trims(n_columns: int, context: int) -> tuple:
    """The trims of schema text to try, in order: tight ones from the start for wide schemas and small contexts."""
    return TIGHT if n_columns >= WIDE_SCHEMA or context <= SMALL_CONTEXT else TRIMS


def trimmed(columns: list[dict], trim: tuple[int | None, int | None]) -> list[dict]:
    """``columns`` with description and instruction (the description, if there is none) cut to the trim, with dots."""
    cut = lambda t, n: t if n is None or len(t) <= n else t[: n - 3] + "..."
    out = []
    for c in columns if trim[0] is not None else []:
        about = str(c.get("description", "")).strip()
        out.append(c | {"description": cut(about, trim[0]), "extraction_instruction": cut(str(c.get("extraction_instruction", "") or about).strip(), trim[1])})
    return out or columns


def context_budget(context: int, system_tokens: int, most_out: int, reserved: int = 0) -> int:
    """Tokens that are left for a user prompt, beside the system prompt, an answer and slack."""
    answer = min(most_out, max(384, context // 3))
    answer = min(answer, max(256, context // 5)) if context <= 6144 else answer
    return max(128, context - (system_tokens + answer + 512) - max(512, int(context * 0.10)) - max(0, reserved))


def tokens(words: Column, chars: Column) -> Column:
    """The estimate of a text of so many words and characters: the greater of words / 0.75 and a third of the characters."""
    return F.greatest(F.floor(words / 0.75), F.floor((chars + 2) / 3)).cast("int")


def size(text: Column) -> Column:
    """Words and characters; both add up over parts that are joined by white space."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.size(F.regexp_extract_all(t, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).alias("words"), F.length(t).alias("chars"))


def fitted(blocks: Column, schemas: list[tuple[int, int]], fixed: tuple[Column, Column], budget: Column, heading: tuple[int, int] = (0, 1)) -> Column:
    """schema (place in ``schemas``), blocks, chars, tokens and fits: the first choice within ``budget`` tokens.

    ``blocks`` are the ranked texts; ``schemas`` holds words and characters of the schema's text under
    each trim, ``fixed`` those of the rest, ``heading`` those that each block brings. Choices come
    in the order of schema (widest first), number of blocks (most first) and characters. Sizes of
    the first n blocks are running sums, so a choice costs an addition. If none fits, it is the last schema and one
    block of the least characters. Null blocks count as none.
    """
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("chars"))
    schema = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(c).alias("chars")) for w, c in schemas])
    chars = F.array(*map(F.lit, CHARS))

    def running(some: Column, most: int) -> Column:
        """Sizes of the first 0, 1, ... blocks cut to ``most`` characters."""
        each = F.transform(some, lambda b: size(F.substring(b, 1, most)))
        add = lambda s, x: F.struct((s["words"] + x["words"] + heading[0]).alias("words"), (s["chars"] + x["chars"] + heading[1]).alias("chars"))
        return F.aggregate(each, F.array(zero), lambda done, x: F.concat(done, F.array(add(F.element_at(done, -1), x))))

    def choice(sums: Column, s: Column, n: Column, c: Column) -> Column:
        many = F.least(n, F.size(F.get(sums, F.lit(0))) - 1)
        of = F.get(F.get(sums, c), many)
        need = tokens(F.get(schema, s)["words"] + of["words"] + fixed[0], F.get(schema, s)["chars"] + of["chars"] + fixed[1])
        return F.struct(s.alias("schema"), many.alias("blocks"), F.get(chars, c).alias("chars"), need.alias("tokens"))

    def chosen(options: Column) -> Column:
        fit = F.get(F.filter(options, lambda o: o["tokens"] <= budget), 0)
        of = lambda o, fits: F.struct(o["schema"].alias("schema"), o["blocks"].alias("blocks"), o["chars"].alias("chars"), o["tokens"].alias("tokens"), fits.alias("fits"))
        return _let(fit, lambda f: F.when(f.isNotNull(), of(f, F.lit(True))).otherwise(of(F.element_at(options, -1), F.lit(False))))

    # In the order of trial: one number stands for the three.
    order = F.sequence(F.lit(0), F.lit(len(schemas) * BLOCKS * len(CHARS) - 1))
    width = BLOCKS * len(CHARS)
    options = lambda sums: F.transform(order, lambda k: choice(sums, F.floor(k / width).cast("int"), (BLOCKS - F.floor(k % width / len(CHARS))).cast("int"), (k % len(CHARS)).cast("int")))
    some = F.slice(F.coalesce(blocks, F.array().cast("array<string>")), 1, BLOCKS)
    return _let(some, lambda x: _let(F.array(*[running(x, c) for c in CHARS]), lambda sums: _let(options(sums), chosen)))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rendered(blocks: Column, choice: Column, separator: str = "\n") -> Column:
    """The chosen blocks, each cut to the chosen characters."""
    return F.array_join(F.transform(F.slice(F.coalesce(blocks, F.array().cast("array<string>")), F.lit(1), choice["blocks"]), lambda b: F.substr(X.sanitize(b), F.lit(1), choice["chars"])), separator)
