"""Which texts hold which of many strings: automata over blocks of the strings, and one pass over the texts for each block."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.blocked import _blocks

#: Bytes that a character of a string takes in the block that is sent and in the automaton.
CHARACTER_BYTES = 64


def containing(texts: DataFrame, strings: DataFrame, id_col: str, text_col: str, string_id: str, string_col: str) -> DataFrame:
    """(text, string): the ids of each text and of each string that it contains, in any case; each pair of rows once.

    An Aho-Corasick automaton finds all strings of a block as it reads a text once, however many they are. Blocks of
    strings are bounded in bytes, and more strings are more passes. A null contains nothing and is contained in nothing;
    every text contains the empty string.
    """
    kind = to_arrow_type(strings.schema[string_id].dataType)
    types = f"text {texts.schema[id_col].dataType.simpleString()}, string {strings.schema[string_id].dataType.simpleString()}"
    read = texts.select(F.col(id_col).alias("text"), F.lower(F.col(text_col)).alias("__body")).filter("__body is not null")
    wanted = strings.select(F.col(string_id).alias("string"), F.lower(F.col(string_col)).alias("body")).filter("body is not null")
    every = None
    for block in _blocks(wanted, lambda body: CHARACTER_BYTES * (len(body) + 1)):
        held = texts.sparkSession.sparkContext.broadcast(block)

        def find(batches, held=held):
            import ahocorasick

            owners: dict[str, list[int]] = {}
            for k, (_, body) in enumerate(held.value):
                owners.setdefault(body, []).append(k)
            everywhere, machine = owners.pop("", []), ahocorasick.Automaton()
            for body, rows in owners.items():
                machine.add_word(body, rows)
            if owners:
                machine.make_automaton()
            for batch in batches:
                places, found = [], []
                for at, body in enumerate(batch.column("__body")):
                    hit = {k for _, rows in machine.iter(body.as_py()) for k in rows} if owners else set()
                    hit.update(everywhere)
                    places += [at] * len(hit)
                    found += sorted(hit)
                yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(places, pa.int32())), pa.array([held.value[k][0] for k in found], kind)], ["text", "string"])

        mine = read.mapInArrow(find, types)
        every = mine if every is None else every.unionByName(mine)
    return every
