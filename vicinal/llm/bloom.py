"""A blocked Bloom filter, made by the executors and of bounded size.

A key sets its bits inside one block of 512, so a look-up touches one block.
The bits of a block are gathered by an aggregation (64-bit words of equal place
are or-ed), and only words that have a bit reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 64 bytes; the filter has no more, however long the list is.
MOST_BLOCKS = 1 << 18
PROBES = 6
#: Keys that a filter of that many blocks can tell apart from others.
MOST_KEYS = MOST_BLOCKS * 512 // 12


@dataclass
class Blocked:
    """``words[b, k]``: word k of block b."""

    words: np.ndarray

    @property
    def n_blocks(self) -> int:
        return len(self.words)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """For 64-bit hashes (as of xxhash64): false if surely not in the list."""
        h = hashes.astype(np.int64)
        block = np.mod(h, self.n_blocks)
        rest = h.view(np.uint64)
        rows = self.words[block]
        out = np.ones(len(h), bool)
        for k in range(PROBES):
            bit = (rest >> np.uint64(9 + 9 * k)) & np.uint64(511)
            word = rows[np.arange(len(h)), (bit >> np.uint64(6)).astype(np.int64)]
            out &= (word >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def blocks_for(keys: int) -> int:
    """About 12 bits a key."""
    return int(min(MOST_BLOCKS, max(16, -(-keys * 12 // 512))))


def build(keys: DataFrame, hashed: Column, expected: int) -> Blocked:
    """The filter of the hashes of all rows; null hashes are left out.  At most 16 MB reach the driver."""
    n = blocks_for(expected)
    rows = keys.select(hashed.alias("h")).where("h is not null").select(F.pmod("h", F.lit(n)).cast("int").alias("block"), "h")
    bits = F.array(*(F.shiftrightunsigned("h", 9 + 9 * k).bitwiseAND(511) for k in range(PROBES)))
    each = rows.select("block", F.explode(bits).alias("bit"))
    gathered = each.groupBy("block", F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = gathered.toArrow()
    words = np.zeros((n, 8), np.uint64)
    words[table.column(0).to_numpy(), table.column(1).to_numpy()] = table.column(2).to_numpy().view(np.uint64)
    return Blocked(words)
