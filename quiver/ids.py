"""Identifiers: [0 | shard: 9 bits | type: 18 bits | local: 36 bits] in one long.

The type of an element is part of its id, so a type test needs no join.  Each
function works on Columns and on plain integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_BITS, TYPE_BITS, SHARD_BITS = 36, 18, 9
MAX_LOCAL, MAX_TYPE, MAX_SHARD = (1 << LOCAL_BITS) - 1, (1 << TYPE_BITS) - 1, (1 << SHARD_BITS) - 1


def make_id(shard: int, type_id: int, local):
    """The id of a local number; a Column gives a Column."""
    if not 0 <= shard <= MAX_SHARD or not 0 <= type_id <= MAX_TYPE:
        raise ValueError(f"shard {shard} or type {type_id} out of range")
    base = (shard << (LOCAL_BITS + TYPE_BITS)) | (type_id << LOCAL_BITS)
    if isinstance(local, Column):
        number = local.cast("long")
        inside = number.isNull() | number.between(0, MAX_LOCAL)
        out = F.concat(F.lit("local id "), number.cast("string"), F.lit(" out of range"))
        return F.when(inside, F.lit(base).cast("long").bitwiseOR(number)).otherwise(F.raise_error(out).cast("long"))
    if not 0 <= local <= MAX_LOCAL:
        raise ValueError(f"local id {local} out of range")
    return base | local


def id_type(x):
    return F.shiftright(x, LOCAL_BITS).bitwiseAND(F.lit(MAX_TYPE)).cast("int") if isinstance(x, Column) else (x >> LOCAL_BITS) & MAX_TYPE


def id_shard(x):
    return F.shiftright(x, LOCAL_BITS + TYPE_BITS).bitwiseAND(F.lit(MAX_SHARD)).cast("int") if isinstance(x, Column) else (x >> (LOCAL_BITS + TYPE_BITS)) & MAX_SHARD


def id_local(x):
    return x.bitwiseAND(F.lit(MAX_LOCAL)) if isinstance(x, Column) else x & MAX_LOCAL


def with_shard(x: int, shard: int) -> int:
    return make_id(shard, id_type(x), id_local(x))
