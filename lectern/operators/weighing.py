"""Weighing of documents by the terms that topics ask for, row by row: what a row holds is added up where it is, nothing is dealt out.

The asked terms and their weights are a measured, small table that every task
gets; larger ones are joined (``retrieve.matches``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a held term and a topic that asks for it which are added up at once.
AT_ONCE = 1 << 20


def _places(terms: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked term that rows hold: the row, and the term's place in ``asked``."""
    n = pc.list_value_length(terms).fill_null(0).to_numpy()
    place = pc.index_in(terms.flatten(), value_set=asked).fill_null(-1).to_numpy()
    hit = np.flatnonzero(place >= 0)
    return np.repeat(np.arange(len(n)), n)[hit], place[hit]


def held(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term and n, in parts that add up: the rows of ``docs`` (terms) that hold each term of ``wanted``, a small table of distinct terms."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted.filter("term is not null").toArrow()["term"].combine_chunks())

    def run(batches):
        asked, n = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            n += np.bincount(_places(batch.column("terms"), asked)[1], minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(met)), pa.array(n[met])], names=["term", "n"])

    return docs.select("terms").mapInArrow(run, "term string, n long")


def pairs(docs: DataFrame, weighed: DataFrame) -> DataFrame:
    """topic_id, the columns of ``docs`` but terms, base, n_common, least_df and n: each row with every topic that asks for a term of its.

    ``weighed`` (topic_id, term, df, n, idf) is small.  Weights are added in the order of a row's terms.
    """
    table = weighed.select("topic_id", "term", "df", "n", "idf").toArrow().sort_by([("term", "ascending"), ("topic_id", "ascending")])
    term, topic = (table[c].combine_chunks().dictionary_encode() for c in ("term", "topic_id"))
    codes, size = topic.indices.to_numpy(), np.bincount(term.indices.to_numpy(), minlength=len(term.dictionary))
    shared = docs.sparkSession.sparkContext.broadcast((term.dictionary, topic.dictionary, codes, size, table["idf"].to_numpy(), table["df"].to_numpy()))
    kept = [c for c in docs.columns if c != "terms"]

    def run(batches):
        asked, topics, codes, size, idf, df = shared.value
        first = np.cumsum(size) - size
        for batch in batches:
            row, place = _places(batch.column("terms"), asked)
            ends = np.cumsum(size[place])
            done = 0
            while done < len(row):
                # whole rows, one at least
                upto = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, side="right"))
                upto = int(np.searchsorted(row, row[min(max(upto, done), len(row) - 1)])) if upto < len(row) else len(row)
                if upto <= done:
                    upto = int(np.searchsorted(row, row[done], side="right"))
                r, p = row[done:upto], place[done:upto]
                done = upto
                n = size[p]
                at = np.arange(int(n.sum())) + np.repeat(first[p] - (np.cumsum(n) - n), n)
                key = np.repeat(r, n) * len(topics) + codes[at]
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                own, key = pa.array(key[start] // len(topics)), pa.array(key[start] % len(topics))
                told = [np.add.reduceat(idf[at], start), np.diff(np.append(start, len(at))), np.minimum.reduceat(df[at], start)]
                yield pa.RecordBatch.from_arrays([topics.take(key), *(batch.column(c).take(own) for c in kept), *map(pa.array, told)], names=["topic_id", *kept, "base", "n_common", "least_df"])

    types = {**{c: docs.schema[c].dataType for c in kept}, "topic_id": weighed.schema["topic_id"].dataType}
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in ("topic_id", *kept)) + ", base double, n_common long, least_df long"
    n = table["n"][0].as_py() if table.num_rows else None
    return docs.select(*kept, "terms").mapInArrow(run, schema).withColumn("n", F.lit(n).cast("long"))
