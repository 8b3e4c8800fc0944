"""The model surface: batch functions under a name, with deterministic offline defaults.

A function takes a list of texts and returns a list of values; it is loaded once a task and called once a batch.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

MODELS: dict[str, Callable[[list], list]] = {}
DIMENSIONS = 64


def register(name: str, f: Callable[[list], list]) -> None:
    MODELS[name] = f


def hash_embedding(texts: list) -> list:
    """Counts of hashed words in DIMENSIONS places, as a unit vector."""
    out = []
    for text in texts:
        v = [0.0] * DIMENSIONS
        for word in re.findall(r"\w+", (text or "").lower()):
            v[zlib.crc32(word.encode()) % DIMENSIONS] += 1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out


def lead_sentences(texts: list, n: int = 3) -> list:
    return [" ".join(re.split(r"(?<=[.!?])\s+", (t or "").strip())[:n]) for t in texts]


def rule_label(texts: list) -> list:
    from docspark.operators.sections import KEYWORDS, phrases

    found = {k: re.compile(phrases(k, r"\b")) for k in KEYWORDS}
    plain = [" ".join((t or "").lower().split()) for t in texts]
    return [next((k for k, p in found.items() if p.search(t)), "other") for t in plain]


def word_overlap(pairs: list) -> list:
    """For (query, text): the share of the query's distinct words that the text holds."""
    out = []
    for pair in pairs:
        want, have = ({*re.findall(r"\w+", (pair[k] or "").lower())} for k in ("query", "text"))
        out.append(len(want & have) / len(want) if want else 0.0)
    return out


def named_values(prompts: list) -> list:
    """For JSON {values: [{code, name}], text}: a JSON array of the values whose name stands in the text, with a reason.
    What comes before the text is read once for prompts that begin alike."""
    out, read = [], {}
    for prompt in prompts:
        head, mark, text = prompt.partition('],"text":')  # quotes within a value are escaped
        if '"values":[' not in head:
            head, mark = prompt, ""
        if (head, mark) not in read:
            values = json.loads(prompt)["values"]
            found = [(v["name"].lower(), json.dumps({"code": v["code"], "reason": f"the text names {v['name']}"})) for v in values if v.get("name")]
            read = {} if len(read) > 100 else read
            read[head, mark] = found
        low = json.loads('{"text":' + text if mark else prompt)["text"].lower()
        held = {name: name in low for name in dict.fromkeys(name for name, _ in read[head, mark])}
        out.append("[" + ", ".join([item for name, item in read[head, mark] if held[name]]) + "]")
    return out


# fixed values: frequent words of each language
FREQUENT = {"en": "the of and to in is that for with this", "fr": "le la les des et en dans que pour une", "es": "el la los de que en y las por una", "de": "der die und das den von zu mit ist nicht"}


def frequent_words(texts: list) -> list:
    """`code share`: the language with most of its frequent words in a text, and its share of all such words found."""
    out = []
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        found = {code: sum(w in known for w in words) for code, known in ((c, set(x.split())) for c, x in FREQUENT.items())}
        best = max(found, key=found.get)
        out.append(f"{best} {found[best] / sum(found.values()):.3f}" if found[best] else "xx 0")
    return out


register("language", frequent_words)
register("scorer", word_overlap)
register("embedder", hash_embedding)
register("summariser", lead_sentences)
register("labeller", rule_label)
register("classifier", named_values)


def apply(df: DataFrame, name: str, col: str, made: str) -> DataFrame:
    """`df` with the column `made` (a name and a type) that the model gives for `col`."""
    f = MODELS[name]
    field = _parse_datatype_string(made)
    schema = StructType([*df.schema, *field])
    label, kind = field[0].name, to_arrow_type(field[0].dataType)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f(batch[col].to_pylist()), kind)], names=[*batch.schema.names, label])

    return df.mapInArrow(run, schema)
