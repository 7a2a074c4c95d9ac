"""Continuous periods and gaps of overlapping intervals, by dyadic blocks.

Every interval of whole days is cut into canonical dyadic blocks (level, index), i.e. aligned runs of 2**level
days. Equal intervals of an entity collapse in a first aggregation with map-side combine, so an entity that holds a
third of all rows is as small as its distinct intervals. Per entity, blocks that repeat or lie under
a kept ancestor are dropped, sibling pairs are merged upward level by level, and what is left is coalesced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of the dyadic grid: 2**TOP days is more than the range of DATE that Parquet holds in practice.
TOP = 22
#: Day numbers are shifted so that they are never negative.
SHIFT = 1 << 21


def dyadic_blocks(df: DataFrame, entity: str, day_from: str, day_until: str) -> DataFrame:
    """Rows (``entity``, lv, ix): the canonical blocks of the distinct valid intervals of ``df``; blocks may repeat.

    Rows with a null day or ``day_from > day_until`` are no intervals and are left out.
    """
    lo = (F.unix_date(F.col(day_from)) + F.lit(SHIFT)).cast("long")
    hi = (F.unix_date(F.col(day_until)) + F.lit(SHIFT + 1)).cast("long")
    ok = F.col(day_from).isNotNull() & F.col(day_until).isNotNull() & (F.col(day_from) <= F.col(day_until))
    spans = df.where(ok).select(F.col(entity).alias("entity"), lo.alias("lo"), hi.alias("hi")).distinct()
    # at each level the open ends are ceil(lo / 2^l) and floor(hi / 2^l); an odd end is a block of its own
    blocks = F.expr(
        f"""flatten(transform(sequence(0, {TOP}), l -> filter(array(
              IF(((lo + shiftleft(1L, l) - 1) DIV shiftleft(1L, l)) % 2 = 1, named_struct('lv', l, 'ix', (lo + shiftleft(1L, l) - 1) DIV shiftleft(1L, l)), NULL),
              IF((hi DIV shiftleft(1L, l)) % 2 = 1, named_struct('lv', l, 'ix', hi DIV shiftleft(1L, l) - 1), NULL)
            ), b -> b IS NOT NULL AND (lo + shiftleft(1L, l) - 1) DIV shiftleft(1L, l) < hi DIV shiftleft(1L, l))))"""
    )
    return spans.select("entity", F.explode(blocks).alias("b")).select("entity", "b.lv", "b.ix")


def _runs(code: np.ndarray, lv: np.ndarray, ix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Continuous runs (code, first day, day after the last) of the blocks of several entities at once.

    ``code`` numbers the entities in order; blocks come by code, first day, falling level.
    """
    start, size = ix << lv, np.int64(1) << lv
    # covered by an ancestor: blocks nest or are apart, so the largest end before it in its entity tells
    end = start + size
    base = code.astype(np.int64) << 40
    reach = np.maximum.accumulate(base + end)
    keep = np.ones(len(code), bool)
    keep[1:] = ~((code[1:] == code[:-1]) & (reach[:-1] >= (base + end)[1:]))
    code, lv, ix = code[keep], lv[keep], ix[keep]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cur_c, cur_i = code[:0], ix[:0]
    for level in range(TOP + 1):
        here = lv == level
        c, i = np.concatenate([cur_c, code[here]]), np.concatenate([cur_i, ix[here]])
        order = np.lexsort((i, c))
        c, i = c[order], i[order]
        pair = np.zeros(len(c), bool)
        pair[:-1] = (c[:-1] == c[1:]) & (i[:-1] % 2 == 0) & (i[1:] == i[:-1] + 1)
        second = np.zeros(len(c), bool)
        second[1:] = pair[:-1]
        rest = ~(pair | second)
        done.append((c[rest], i[rest] << level, (i[rest] + 1) << level))
        cur_c, cur_i = c[pair], i[pair] >> 1
    done.append((cur_c, cur_i << (TOP + 1), (cur_i + 1) << (TOP + 1)))
    c, a, b = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((a, c))
    c, a, b = c[order], a[order], b[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (a[1:] > b[:-1])
    last = np.append(first[1:], True) if len(c) else first
    return c[first], a[first], b[last]


def _coalesce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None

    def done(part: pd.DataFrame) -> pd.DataFrame:
        code = (part["entity"] != part["entity"].shift()).cumsum().to_numpy() - 1
        names = part["entity"].to_numpy()[np.flatnonzero(np.diff(code, prepend=-1))]
        c, a, b = _runs(code, part["lv"].to_numpy(np.int64), part["ix"].to_numpy(np.int64))
        gap = np.flatnonzero(c[1:] == c[:-1]) if len(c) else np.array([], int)
        return pd.DataFrame(
            {
                "entity": np.concatenate([names[c], names[c[gap]]]),
                "kind": ["period"] * len(c) + ["gap"] * len(gap),
                "d1": np.concatenate([a, b[gap]]) - SHIFT,
                "d2": np.concatenate([b - 1, a[gap + 1] - 1]) - SHIFT,
            }
        )

    for part in batches:
        part = part if held is None else pd.concat([held, part], ignore_index=True)
        if part.empty:
            continue
        # the last entity may go on in the next batch
        ahead = part["entity"] == part["entity"].iloc[-1]
        held = part[ahead]
        if not ahead.all():
            yield done(part[~ahead].reset_index(drop=True))
    if held is not None and not held.empty:
        yield done(held.reset_index(drop=True))


def periods_and_gaps(df: DataFrame, entity: str = "id", day_from: str = "valid_from", day_until: str = "valid_until") -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    Result: ``entity`` (under its own name), ``kind`` (``period`` or ``gap``), ``day_from`` and ``day_until`` as DATE,
    both inclusive. Intervals that overlap, nest or touch (next day) are one period; a gap lies between two periods.
    Rows with a missing day or turned-round days are ignored; rows without an entity are ignored; repeated rows do not
    matter; an empty table gives an empty result. Other columns of ``df`` may have any names.
    """
    blocks = dyadic_blocks(df.where(F.col(entity).isNotNull()), entity, day_from, day_until)
    by_entity = blocks.repartition("entity").sortWithinPartitions("entity", F.expr("shiftleft(ix, lv)"), F.desc("lv"))
    schema = T.StructType([T.StructField("entity", df.schema[entity].dataType), T.StructField("kind", T.StringType()), T.StructField("d1", T.IntegerType()), T.StructField("d2", T.IntegerType())])
    out = by_entity.mapInPandas(_coalesce, schema)
    return out.select(F.col("entity").alias(entity), "kind", F.date_from_unix_date("d1").alias("day_from"), F.date_from_unix_date("d2").alias("day_until"))
