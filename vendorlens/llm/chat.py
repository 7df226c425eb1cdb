"""Chat formatting: records of different layouts become canonical turns and one marked text.

A record is a JSON object. The sorted paths of its nested fields hash to a fingerprint that selects a
declared layout (lists of messages, prompt and response, instruction). Each layout hashes the paths that it
knows itself, so fields beside them do not matter, whatever other layout uses them; layouts with more required
paths are asked first, lists of messages before single fields. The template marks turns; control strings inside roles and texts are escaped
reversibly, so the turns can be read back from the text. The loss mask covers the assistants' texts.

Defined results: a null text is empty, a null role too; a record that is no JSON object, that nests too deep to be
read, whose messages are no list of objects, or that fits no layout gives a null layout and no turns; a record
without messages gives no turns; half of a surrogate pair reads as the replacement character; repeated records
are formatted each for itself.
"""
from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.textarrays import per_text

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Where a kind of record keeps its turns: either a list of messages, or single fields in order."""

    name: str
    messages: str | None = None                       # field that holds the list
    role: str = ""
    text: str = ""
    roles: dict = field(default_factory=dict, hash=False)  # renamed roles
    turns: tuple = ()                                 # (role, fields whose texts are joined by a blank line)
    optional: tuple = ()

    def path_sets(self):
        if self.messages:
            for extra in _subsets(self.optional):
                yield frozenset({self.messages, *extra})
                yield frozenset({self.messages, f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}", *extra})
            return
        fields = {f for _, fs in self.turns for f in fs} - set(self.optional)
        for extra in _subsets(self.optional):
            yield frozenset(fields | set(extra))

    def read(self, record: dict) -> list[tuple[str, str]] | None:
        """The turns; None if the messages are no list of objects."""
        if self.messages:
            held = record[self.messages]
            if held is not None and not (isinstance(held, list) and all(isinstance(m, dict) for m in held)):
                return None
            first = [("system", _text(record["system"]))] if "system" in self.optional and "system" in record else []
            return first + [(self.roles.get(r := _text(m.get(self.role)), r), _text(m.get(self.text))) for m in held or []]
        out = []
        for role, fields in self.turns:
            held = [_text(record.get(f)) for f in fields if f in record]
            if held:
                out.append((role, "\n\n".join(t for t in held if t)))
        return out


def _subsets(items):
    return itertools.chain.from_iterable(itertools.combinations(items, k) for k in range(len(items) + 1))


def _text(value) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


LAYOUTS = (
    Layout("messages", messages="messages", role="role", text="content", optional=("system",)),
    Layout("conversations", messages="conversations", role="from", text="value",
           roles={"human": "user", "gpt": "assistant"}, optional=("system",)),
    Layout("prompt_completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
           optional=("system", "input")),
    Layout("question_answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)


def paths(value) -> set[str]:
    """The paths of all nested fields; list elements share one path."""
    out, todo = set(), [(value, "")]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                p = f"{at}.{k}" if at else k
                out.add(p)
                todo.append((v, p))
        elif isinstance(value, list):
            todo += [(v, f"{at}[]") for v in value]
    return out


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def registry(layouts=LAYOUTS) -> list[tuple[Layout, set[str], set[str]]]:
    """Per layout the paths that it knows and the fingerprints that it reads, in the order of asking."""
    out = []
    for x in layouts:
        sets = list(x.path_sets())
        out.append((x, set().union(*sets), {fingerprint(s) for s in sets}))
    least = {x.name: min(map(len, x.path_sets())) for x in layouts}
    return sorted(out, key=lambda e: (e[0].messages is None, -least[e[0].name]))


def canonical(record: str | None, asked: list[tuple[Layout, set[str], set[str]]]):
    """(layout name or None, fingerprint, turns) of one record."""
    try:
        value = json.loads(record) if record else None
        if not isinstance(value, dict):
            return None, None, []
        found = paths(value)
        for layout, known, prints in asked:
            key = fingerprint(found & known)
            if key in prints and (turns := layout.read(value)) is not None:
                return layout.name, key, turns
        return None, fingerprint(found & set().union(*(known for _, known, _ in asked))), []
    except (ValueError, RecursionError):
        return None, None, []


def escape(text: str) -> str:
    r"""Afterwards "<|" does not occur; every backslash is followed by a backslash, a bar or n."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistants' (escaped) texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}".replace("\n", "\\n") + "\n", escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        out += [head, body, END, "\n"]
        at += len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted text."""
    out = []
    for part in formatted.split(END + "\n")[:-1]:
        role, text = part.removeprefix(START).split("\n", 1)
        out.append((unescape(role), unescape(text)))
    return out


def format_records(records: DataFrame, keep: list[str], column: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Struct ``doc`` with the kept columns, ``layout``, ``fingerprint``, ``formatted`` and ``loss`` (spans)."""
    def make():
        asked = registry(layouts)

        def fn(texts):
            cols = [], [], [], []
            for r in texts.to_pylist():
                name, key, turns = canonical(r, asked)
                text, spans = render(turns)
                for c, v in zip(cols, (name, key, text, [{"start": a, "end": b} for a, b in spans])):
                    c.append(v)
            kinds = pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(c, k) for c, k in zip(cols, kinds)]
        return fn

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return per_text(records, keep, [("layout", T.StringType()), ("fingerprint", T.StringType()),
                                    ("formatted", T.StringType()), ("loss", span)], make, column)


def read_back(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """Struct ``doc``, ``turns`` (role, text) and ``loss_text`` (unescaped text under the mask), from
    ``formatted`` and ``loss`` alone."""
    def run(batches):
        for batch in batches:
            doc, turns, loss = batch.column(0), [], []
            for text, spans in zip(doc.field("formatted").to_pylist(), doc.field("loss").to_pylist()):
                turns.append([{"role": r, "text": t} for r, t in parse(text)])
                loss.append("".join(unescape(text[s["start"]:s["end"]]) for s in spans))
            kept = pa.StructArray.from_arrays([doc.field(c) for c in keep], keep)
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([kept, pa.array(turns, kind), pa.array(loss, pa.string())], ["doc", "turns", "loss_text"])

    turn = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    out = T.StructType([T.StructField("doc", T.StructType([formatted.schema[c] for c in keep])), T.StructField("turns", turn),
                        T.StructField("loss_text", T.StringType())])
    cols = list(dict.fromkeys([*keep, "formatted", "loss"]))
    return formatted.select(F.struct(*cols).alias("doc")).mapInArrow(run, out)


def mixed_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record per conversation, in layouts that differ: by the hash of its
    id a conversation becomes a list of messages, a list of conversations with their own role names (unless it uses
    those names itself), or, if it is one user's and one assistant's turn, a prompt and its completion."""
    turns = _ordered_turns(rows).withColumn("kind", F.pmod(F.xxhash64("conv_id"), F.lit(3)))
    roles = F.transform("m", lambda x: x["role"])
    foreign = {"user": "human", "assistant": "gpt"}
    renamed = lambda r: F.when(r == "user", foreign["user"]).when(r == "assistant", foreign["assistant"]).otherwise(r)
    free = ~F.arrays_overlap(roles, F.array(*map(F.lit, foreign.values())))
    pair = (F.size("m") == 2) & (F.array_join(roles, "\n") == "user\nassistant")
    messages = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    conversations = F.to_json(F.struct(F.transform("m", lambda x: F.struct(renamed(x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations")))
    prompt = F.to_json(F.struct(F.col("m")[0]["content"].alias("prompt"), F.try_element_at("m", F.lit(2))["content"].alias("completion")))
    return turns.select("conv_id", F.when((F.col("kind") == 0) & free, conversations).when((F.col("kind") == 1) & pair, prompt)
                        .otherwise(messages).alias("record"))


def _ordered_turns(rows: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))


def message_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record per conversation, turns in order (ties by role
    and text). A conversation is one record whatever its length."""
    return _ordered_turns(rows).select("conv_id", F.to_json(F.struct(F.transform(
        "m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("record"))
