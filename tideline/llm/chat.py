"""Chat formatting with schema fingerprinting.

A record's layout is known by its fingerprint: the hash of its sorted nested field paths. A registry maps fingerprints to
declarative mappings, which turn prompt, instruction and message layouts, and tables of one row a turn, into canonical turns
(conv_id, turn, role, text). Of a table the fingerprint is that of its schema, so one mapping serves all of its rows; of a column of
JSON records each row has its own.
The template then renders each turn as

    <|im_start|>{role}<|im_sep|>{text}<|im_end|>

and a conversation is its turns in order. Control strings (those of the template and of other common ones) inside roles and
texts are broken by a backslash behind their first character, and backslashes are doubled, so that no control string occurs
in the output but the template's own, and reading back restores every text. The loss mask covers the texts of assistant turns.

Each turn is one row of output, so no conversation, however long, is held in one row or list; `read_back` goes through the
turns of a conversation as a stream. Defined results: null roles and texts count as empty (texts of any length are formatted
whole), a null turn comes first; equal turn numbers are ordered by role, then text; repeated rows count as often as they occur;
rows with a null conversation are one conversation; a table whose layout no mapping knows is an error that names its paths, while
JSON records of unknown layouts are returned apart; columns that no mapping uses don't matter where the paths of exactly one
mapping of the most fields are there; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common chat templates: fixed values.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\\\|\\")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)


# layouts


def paths(value: Any, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value; list items share the path of their list."""
    if isinstance(value, dict):
        return {at} | {p for k, v in value.items() for p in paths(v, f"{at}.{k}")}
    if isinstance(value, list):
        return {f"{at}[]"} | {p for v in value for p in paths(v, f"{at}[]")}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same for a schema."""
    if isinstance(kind, T.StructType):
        return {at} | {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}")}
    if isinstance(kind, T.ArrayType):
        return {f"{at}[]"} | schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _known(*fields: str) -> set[str]:
    """All paths that lead to the fields."""
    out = {""}
    for f in fields:
        at = ""
        for part in f.split("."):
            at += f".{part.removesuffix('[]')}"
            if part.endswith("[]"):
                at += "[]"
        out.add(at)
        while at:
            at = at.removesuffix("[]") if at.endswith("[]") else at.rpartition(".")[0]
            if at and not any(p.startswith(f"{at}[]") for p in out):
                out.add(at)
    return out


#: Mappings by layout. fields: what makes the fingerprint. messages: list, role and text fields, and names of roles.
#: turns: (role, fields) in order, non-empty fields joined by a blank line; a turn without any text is left out.
LAYOUTS: dict[str, dict[str, Any]] = {
    "flat_turns": {"fields": ("turn", "role", "text"), "flat": ("turn", "role", "text")},
    "flat_messages": {"fields": ("turn", "role", "content"), "flat": ("turn", "role", "content")},
    "messages": {"fields": ("messages[].role", "messages[].content"), "messages": ("messages", "role", "content")},
    "conversations": {"fields": ("conversations[].from", "conversations[].value"), "messages": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    "prompt": {"fields": ("prompt", "response"), "turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    "completion": {"fields": ("prompt", "completion"), "turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "instruction": {"fields": ("instruction", "output"), "turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction_input": {"fields": ("instruction", "input", "output"), "turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "system_prompt": {"fields": ("system", "prompt", "response"), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
}
REGISTRY = {fingerprint(_known(*m["fields"])): m for m in LAYOUTS.values()}


def turns_of(record: dict[str, Any]) -> list[tuple[str, str]] | None:
    """Canonical turns of a record, or None where its fingerprint isn't known."""
    mapping = REGISTRY.get(fingerprint(paths(record)))
    if mapping is None:
        return None
    if "flat" in mapping:
        _, role, text = mapping["flat"]
        return [(record[role] or "", record[text] or "")]
    if "messages" in mapping:
        items, role, text = mapping["messages"]
        names = mapping.get("roles", {})
        return [(names.get(m[role], m[role]) or "", m[text] or "") for m in record[items]]
    out = [(role, "\n\n".join(str(record[f]) for f in fields if record[f])) for role, fields in mapping["turns"]]
    return [(role, text) for role, text in out if text]


def canonical_turns(records: DataFrame, *, record: str = "record", conv_id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Turns of rows that hold one JSON record each, and the rows whose layout isn't known (conv_id, record, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"conv_id": [], "record": [], "fingerprint": [], "turns": []}
            for i, raw in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(raw or "")
                except ValueError:
                    value = None
                turns = turns_of(value) if isinstance(value, dict) else None
                out["conv_id"].append(i.as_py())
                out["record"].append(raw if turns is None else None)
                out["fingerprint"].append(fingerprint(paths(value)) if value is not None else None)
                out["turns"].append(None if turns is None else [{"role": r, "text": str(t)} for r, t in turns])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("conv_id", b.schema.field(0).type), ("record", pa.string()), ("fingerprint", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]))

    chosen = records.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"))
    parsed = chosen.mapInArrow(run, T.StructType([chosen.schema["conv_id"], T.StructField("record", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))]))
    known = parsed.filter(F.col("turns").isNotNull()).select("conv_id", F.posexplode("turns").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")
    return known, parsed.filter(F.col("turns").isNull()).select("conv_id", "record", "fingerprint")


def select_mapping(found: set[str]) -> dict[str, Any] | None:
    """The mapping whose fingerprint is that of the paths; where there are further paths, the mapping of most fields whose own
    paths, and none but those, are left when the rest is taken away, unless two have as many."""
    exact = REGISTRY.get(fingerprint(found))
    if exact is not None:
        return exact
    fit = [m for m in LAYOUTS.values() if REGISTRY.get(fingerprint(found & _known(*m["fields"]))) is m]
    most = max((len(m["fields"]) for m in fit), default=0)
    best = [m for m in fit if len(m["fields"]) == most]
    return best[0] if len(best) == 1 else None


def table_turns(df: DataFrame, *, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns of a table whose columns (beside conv_id) are one layout: its schema's fingerprint selects the mapping, and
    the rest is column expressions."""
    own = schema_paths(T.StructType([f for f in df.schema.fields if f.name != conv_id]))
    mapping = select_mapping(own)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(own)}")
    conv, long = F.col(conv_id).alias("conv_id"), lambda c: F.col(c).cast("long").alias("turn")
    if "flat" in mapping:
        turn, role, text = mapping["flat"]
        return df.select(conv, long(turn), F.col(role).alias("role"), F.col(text).alias("text"))
    if "messages" in mapping:
        items, role, text = mapping["messages"]
        names = F.col(f"m.{role}")
        for a, b in mapping.get("roles", {}).items():
            names = F.when(F.col(f"m.{role}") == a, b).otherwise(names)
        return df.select(conv, F.posexplode(items).alias("turn", "m")).select("conv_id", long("turn"), names.alias("role"), F.col(f"m.{text}").alias("text"))
    made = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in fields)).alias("text")) for role, fields in mapping["turns"]))
    return df.select(conv, F.posexplode(F.filter(made, lambda m: m["text"] != "")).alias("turn", "m")).select("conv_id", long("turn"), "m.role", "m.text")


# template


def _escaped(col: Column) -> Column:
    """escape() as column functions: doubles backslashes, breaks control strings."""
    out = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(out, "|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL), "".join(f"${i + 1}" for i in range(len(CONTROL))) + r"\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted (the turn in the template), loss_start and loss_end (code points of the masked span within
    formatted; equal where nothing is masked) for every row."""
    role, text = _escaped(F.col("role")), _escaped(F.col("text"))
    out = turns.select("conv_id", "turn", role.alias("r"), text.alias("t"), F.coalesce(F.col("role").isin(*LOSS_ROLES), F.lit(False)).alias("loss"))
    start = F.length("r") + len(START) + len(SEP)
    return out.select("conv_id", "turn", F.concat(F.lit(START), "r", F.lit(SEP), "t", F.lit(END)).alias("formatted"), start.alias("loss_start"), F.when(F.col("loss"), start + F.length("t")).otherwise(start).alias("loss_end"))


def _unescaped(col: Column) -> Column:
    """unescape() as a column function."""
    return F.regexp_replace(col, r"\\(\\?)", "$1")


SUMMARY = T.StructType([T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted turns: their number, the digest of roles and texts, the length and digest of
    the text under the loss mask, the formatted length. Rows of a conversation meet in one task (a digest has one order) but
    are sorted by Spark and read as a stream, so memory doesn't grow with a conversation."""
    kinds = T.StructType([formatted.schema["conv_id"], *SUMMARY.fields])
    role = F.substring_index(F.substring("formatted", len(START) + 1, 1 << 30), SEP, 1)
    text = F.expr(f"substring(formatted, length(r) + {len(START) + len(SEP) + 1}, length(formatted) - length(r) - {len(START) + len(SEP) + len(END)})")
    parts = formatted.repartition("conv_id").withColumn("r", role).withColumns({"r_own": _unescaped(F.col("r")), "t_own": _unescaped(text)})
    ordered = parts.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "r_own", "t_own").drop("r", "r_own", "t_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for b in batches:
            done: list[list] = []
            names = ("conv_id", "formatted", "loss_start", "loss_end")
            for conv, text, lo, hi in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = _TURN.fullmatch(text)
                role, said = unescape(m[1]), unescape(m[2])
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(text[lo:hi])
                now[3] += len(masked)
                now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if done:
                yield rows(done, b.schema.field("conv_id").type)
            kind = b.schema.field("conv_id").type
        if now is not None:
            yield rows([now], kind)

    def rows(done: list[list], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*((c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in done), strict=True))
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=kinds.names)

    return ordered.mapInArrow(run, kinds)


def op2(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    ask = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", ask), (-1, 1, "assistant", ask)], "conv_id long, turn long, role string, text string")
    turns = table_turns(conversations).unionByName(table_turns(probe))
    return read_back(format_turns(turns.withColumn("conv_id", F.col("conv_id").cast("long"))))
