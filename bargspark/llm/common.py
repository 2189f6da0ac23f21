"""What the operators of this subpackage share: reading, spreading and keeping tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bargspark.functions.batches import slices  # noqa: F401
from bargspark.session import keep, ship  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """The named columns of a table; the scan reads no others."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores is dealt out evenly, so that Python work uses all of them; larger inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


class Memo(dict):
    """A dict that fills itself from a function and empties itself at `most` entries; a cache only, results never depend on it."""

    def __init__(self, make, most: int = 60_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


#: A bit table has at most 2**POWER bits (8 MB), and FREE bits for each member where it fits. One that is more than half full is no help and lets everything pass.
POWER, FREE, PART = 26, 256, 20


def _bit_table(at: DataFrame, power: int) -> tuple[bytes | None, int]:
    """(table or None if it lets everything pass, mask) of one column of numbers below 2**power. Tasks build parts of 2**20 bits; the driver gets no more than the table."""
    size = 1 << min(PART, power)

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            part = x // size
            for p in np.unique(part).tolist():
                bits = np.zeros(size, bool)
                bits[x[part == p] % size] = True
                packed = np.packbits(bits, bitorder="little")
                parts[p] = parts[p] | packed if p in parts else packed
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["part", "bits"])

    column = F.col(at.columns[0])
    table = np.zeros(1 << power >> 3, np.uint8)
    for r in at.repartition(F.floor(column / size)).mapInArrow(run, "part int, bits binary").collect():  # at most the table, compressed
        i = r["part"] * size >> 3
        table[i : i + (size >> 3)] |= np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    ones = int(np.bitwise_count(table).sum())
    if ones > 1 << power >> 1:
        return None, (1 << power) - 1
    while power > 10 and ones * FREE <= 1 << power >> 1:
        half = len(table) // 2
        table, power = table[:half] | table[half:], power - 1
    return table.tobytes(), (1 << power) - 1


class Numbers:
    """A set of 64-bit numbers that are spread evenly, such as hashes or ids, as a bit table for a broadcast of bounded size: false positives cost time only, an exact join follows."""

    def __init__(self, numbers: DataFrame, power: int = POWER):
        self.table, self.mask = _bit_table(numbers.select(F.pmod(F.col(numbers.columns[0]), F.lit(1 << power)).cast("int").alias("bit")).where("bit IS NOT NULL"), power)

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Which of the numbers may be in the set."""
        if self.table is None:
            return np.ones(len(values), bool)
        at = values & self.mask
        return (np.frombuffer(self.table, np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool)


class Bits(Numbers):
    """The same of texts, by their CRC-32."""

    def __init__(self, words: DataFrame, power: int = POWER):
        self.table, self.mask = _bit_table(words.select(F.expr(f"cast(pmod(crc32(encode({words.columns[0]}, 'utf-8')), {1 << power}) as int) AS bit")).where("bit IS NOT NULL"), power)

    def __contains__(self, text: str) -> bool:
        if self.table is None:
            return True
        i = zlib.crc32(text.encode("utf-8", "surrogatepass")) & self.mask
        return bool(self.table[i >> 3] >> (i & 7) & 1)


def _list_hits(c: pa.Array, known: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(which elements hit, end of each list among the elements, from 0)."""
    sizes = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    return known.hits(c.flatten().to_numpy(zero_copy_only=False)), np.concatenate([[0], np.cumsum(sizes)])


def of_numbers(df: DataFrame, column: str, numbers: Numbers) -> DataFrame:
    """The rows whose number may be in the set, or whose array holds no number that can't be. Only the column goes to Python."""
    if numbers.table is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(numbers)

    def hit(c: pa.Array) -> pa.Array:
        if not pa.types.is_list(c.type):
            return pa.array(shared.value.hits(c.to_numpy(zero_copy_only=False)))
        ok, ends = _list_hits(c, shared.value)
        n = np.diff(np.concatenate([[0], np.cumsum(ok)])[ends])
        return pa.array(n == np.diff(ends))

    return df.where(F.arrow_udf(hit, "boolean")(column))


def only_numbers(df: DataFrame, column: str, numbers: Numbers) -> DataFrame:
    """The array less the numbers that can't be in the set."""
    if numbers.table is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(numbers)

    def part(c: pa.Array) -> pa.Array:
        ok, ends = _list_hits(c, shared.value)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok)])[ends].astype(np.int32)), c.flatten().filter(pa.array(ok)))

    return df.withColumn(column, F.arrow_udf(part, "array<bigint>")(column))


def of_texts(df: DataFrame, column: str, bits) -> DataFrame:
    """The rows whose text may be in the set of a broadcast Bits; null never is. Only the column goes to Python."""

    def hit(c: pa.Array) -> pa.Array:
        return pa.array([x is not None and x in bits.value for x in c.to_pylist()], pa.bool_())

    return df.where(F.arrow_udf(hit, "boolean")(column))


def batch_of(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as an Arrow batch of the named types."""
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))
