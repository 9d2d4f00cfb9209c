"""Filling containers of a fixed capacity with texts: sum-of-squares online packing.

Texts are placed one after another. A level array counts the open containers by their fill; a text of size
s goes to the level h (0 is a new container) that makes the sum of the squared counts smallest, of
h + s up to the capacity; of equal choices the fullest. A text longer than the capacity fills whole
containers first, and its rest is placed like any text. No other text is split.

The texts are spread by a hash of their keys over blocks of about ``BLOCK`` texts, and each block is
packed on its own, in the order of the keys, so a run over any number of texts is parallel and every task is
bounded. A block leaves its containers filled but for a few, so blocks cost little space together.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talaan.llm.tokenizer import VOCABULARY, count_column
from talaan.runtime import cut

CAPACITY = 2048
BLOCK = 25_000


def place(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each size (1 to ``capacity``), in the order given."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # counts[h]: open containers with fill h
    open_: dict[int, list[int]] = defaultdict(list)
    out, used = [], 0
    for s in sizes:
        # growth of the sum of squares when a container of fill h becomes one of h + s
        top = capacity - s
        grow = 2 * counts[s:] + 1
        grow[top] = 0  # a full container leaves the array
        grow[1:] += 1 - 2 * counts[1 : top + 1]
        allowed = counts[: top + 1] > 0
        allowed[0] = True
        grow = np.where(allowed, grow, np.iinfo(np.int64).max)
        h = top - int(np.argmin(grow[::-1]))
        if h:
            counts[h] -= 1
            box = open_[h].pop()
        else:
            box, used = used, used + 1
        if h + s < capacity:
            counts[h + s] += 1
            open_[h + s].append(box)
        out.append(box)
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``key``, ``piece_no``, ``first_token``, ``n_tokens``, ``container_id`` of each placed piece.

    Sizes that are null or below 1 are placed nowhere; a null key is a key like any other; repeated
    rows are texts of their own. ``container_id`` is unique over all blocks.
    """
    s = sizes.select(F.col(key).alias("key_"), F.col(size).cast("long").alias("size_")).where("size_ > 0")
    n = s.count()
    blocks = max(1, round(n / block))
    s = s.withColumn("block_", F.pmod(F.xxhash64("key_"), F.lit(blocks)).cast("int"))
    schema = f"key_ {s.schema['key_'].dataType.simpleString()}, piece_no int, first_token bigint, n_tokens int, container_id string"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key_", "size_"], kind="stable", na_position="last")
        b = int(pdf["block_"].iloc[0])
        rows, rest, full = [], [], 0
        for k, n in zip(pdf["key_"].tolist(), pdf["size_"].tolist()):
            k = None if k is pd.NA or k != k else k
            whole = (n - 1) // capacity if n > capacity else 0
            for i in range(whole):
                rows.append((k, i, i * capacity, capacity, f"{b}-f{full}"))
                full += 1
            rest.append((k, whole, whole * capacity, n - whole * capacity))
        for (k, i, first, m), box in zip(rest, place([r[3] for r in rest], capacity)):
            rows.append((k, i, first, m, f"{b}-{box}"))
        return pd.DataFrame(rows, columns=["key_", "piece_no", "first_token", "n_tokens", "container_id"], dtype=object)

    return s.groupBy("block_").applyInPandas(fill, schema).withColumnRenamed("key_", key)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` over the texts' sizes in tokens; null and empty texts are placed nowhere."""
    sized = cut(documents.select(F.col(key), count_column(F.col(text), vocabulary).alias("size_")))
    return pack(sized, key, "size_", capacity)
