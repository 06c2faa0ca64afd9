"""Chat formatting as a prefix tree: conversations that begin alike share the turns they have in common.

Conversations are range-partitioned and sorted by the hashes of their turns, so those that share a beginning are
neighbours, and walking them in that order is a depth-first walk of their prefix tree: only the turns after the
longest common beginning with the conversation before are new, and just those are emitted, once in all. A token is a
code point of the formatted text here, so the text of a pack is its token stream.

The stream is written in packs of a bounded size. A turn that is shared over the edge of a pack stays where it was
emitted, and later packs point to it by pack and interval. Where a partition begins with turns that the one before
ended with, they're taken out again: the walk of each partition says what its first and last conversations were
(two rows per task for the driver), and a second, narrow step cuts those turns off its first pack and redirects what
points to them.

Each node (turn) carries its place in the stream, the position id of its first token (what precedes it on its own
path), the span of its body, whether the body counts for the loss, and the stream intervals of its ancestors, which
with its own earlier tokens are all that its tokens may attend to.

The template is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|`` (in a role a line feed becomes ``\\n``), so no text can end a turn, and ``unescape`` restores it.

Defined results: a null text or role is empty; rows that tie on turn are ordered by role, then text; repeated rows
are turns like any other; a row with a null conv_id is a conversation of its own, of one turn; an empty table gives no
packs; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import join_checked, materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)
INTERVAL = "struct<pack:bigint,start:int,end:int>"
PLACE = "struct<pack:bigint,node:int>"
NODE = f"struct<parent:{PLACE},start:int,length:int,position:int,body:int,body_length:int,loss:boolean,attend:array<{INTERVAL}>>"
MEMBER = f"struct<conv_id:bigint,leaf:{PLACE},spans:array<{INTERVAL}>>"
EDGE = "struct<turn:binary,pack:bigint,node:int,start:int,length:int>"
PACK = f"pack long, text string, nodes array<{NODE}>, members array<{MEMBER}>"
DRAFT = f"{PACK}, first array<{EDGE}>, last array<{EDGE}>"
INTERVAL_ARROW = pa.struct([("pack", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
PLACE_ARROW = pa.struct([("pack", pa.int64()), ("node", pa.int32())])
EDGE_ARROW = pa.list_(pa.struct([("turn", pa.binary()), ("pack", pa.int64()), ("node", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))
PACK_ARROW = pa.schema([
    ("pack", pa.int64()),
    ("text", pa.string()),
    ("nodes", pa.list_(pa.struct([
        ("parent", PLACE_ARROW),
        *((n, pa.int32()) for n in ("start", "length", "position", "body", "body_length")),
        ("loss", pa.bool_()),
        ("attend", pa.list_(INTERVAL_ARROW)),
    ]))),
    ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", PLACE_ARROW), ("spans", pa.list_(INTERVAL_ARROW))]))),
])
DRAFT_ARROW = pa.schema([*PACK_ARROW, ("first", EDGE_ARROW), ("last", EDGE_ARROW)])
#: A pack's number is its partition times this, plus its number there.
PACKS = 1 << 32
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its body starts and how long that is."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(body)


def with_interval(spans: list[dict], pack: int, start: int, end: int) -> list[dict]:
    """Spans and another interval, joined to the last one where it goes on from there."""
    if spans and spans[-1]["pack"] == pack and spans[-1]["end"] == start:
        return [*spans[:-1], {"pack": pack, "start": spans[-1]["start"], "end": end}]
    return [*spans, {"pack": pack, "start": start, "end": end}]


class Walk:
    """The walk of one partition: conversations come in sorted order, packs go out."""

    def __init__(self, part: int, loss_role: str):
        self.loss_role, self.number = loss_role, part * PACKS
        self.path: list[dict] = []  # turns of the conversation before: what they say, where they are, what they attend to
        self.first: list[dict] | None = None
        self.clear()

    def clear(self) -> None:
        self.text: list[str] = []
        self.size, self.nodes, self.members = 0, [], []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and turns[shared] == self.path[shared]["said"]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            rendered, body, n = render(role, text)
            up = self.path[-1] if self.path else None
            own = {
                "parent": {"pack": up["pack"], "node": up["node"]} if up else None, "start": self.size, "length": len(rendered),
                "position": up["position"] + up["length"] if up else 0, "body": self.size + body, "body_length": n, "loss": role == self.loss_role, "attend": up["spans"] if up else [],
            }
            turn = xxhash.xxh3_128_digest((up["turn"] if up else b"") + f"{len(role)} {role}{text}".encode())
            spans = with_interval(own["attend"], self.number, self.size, self.size + len(rendered))
            self.path.append({"said": (role, text), "turn": turn, "pack": self.number, "node": len(self.nodes), "start": self.size, "length": len(rendered), "position": own["position"], "spans": spans})
            self.nodes.append(own)
            self.text.append(rendered)
            self.size += len(rendered)
        if self.first is None:
            self.first = self.edge()
        leaf = self.path[-1]
        self.members.append({"conv_id": conv_id, "leaf": {"pack": leaf["pack"], "node": leaf["node"]}, "spans": leaf["spans"]})

    def edge(self) -> list[dict]:
        return [{k: x[k] for k in ("turn", "pack", "node", "start", "length")} for x in self.path]

    def close(self, last: bool = False) -> pa.RecordBatch:
        """The pack so far; the partition's first one says how it begins, the last one how it ends."""
        begins = self.first if self.number % PACKS == 0 else None
        row = {"pack": self.number, "text": "".join(self.text), "nodes": self.nodes, "members": self.members, "first": begins, "last": self.edge() if last else None}
        self.number += 1
        self.clear()
        return pa.RecordBatch.from_pylist([row], DRAFT_ARROW)


def shared_edges(edges: list[tuple[list[dict], list[dict]]]) -> dict[int, list[tuple[dict, dict]]]:
    """For the first packs of partitions that begin with turns of earlier ones: these turns, as they are there and where they belong.

    edges: the first and last path of each partition, in order; the result's places are those after the cut.
    """
    out: dict[int, list[tuple[dict, dict]]] = {}
    before: list[dict] = []  # the last path so far, with final places
    for first, last in edges:
        n = 0
        while n < min(len(first), len(before)) and first[n]["turn"] == before[n]["turn"]:
            n += 1
        taken = list(zip(first[:n], before[:n]))
        pack, cut = first[0]["pack"], sum(x["length"] for x in first[:n])
        if n:
            out[pack] = taken
        final = []
        for x in last:
            if x["pack"] != pack:
                final.append(x)
            elif x["node"] < n:
                final.append(taken[x["node"]][1])
            else:
                final.append({**x, "node": x["node"] - n, "start": x["start"] - cut})
        before = final
    return out


def redirected(row: dict, shared: dict[int, list[tuple[dict, dict]]]) -> dict:
    """A pack without the turns that belong to earlier packs, and with what points to such turns pointed to their places."""
    first = row["pack"] - row["pack"] % PACKS
    if first not in shared:
        return row
    taken = shared[first]
    n, cut = len(taken), sum(x["length"] for x, _ in taken)

    def place(p: dict | None) -> dict | None:
        if p is None or p["pack"] != first:
            return p
        if p["node"] >= n:
            return {"pack": first, "node": p["node"] - n}
        return {"pack": taken[p["node"]][1]["pack"], "node": taken[p["node"]][1]["node"]}

    def spans(some: list[dict]) -> list[dict]:
        out: list[dict] = []
        for x in some:
            if x["pack"] != first:
                out = with_interval(out, x["pack"], x["start"], x["end"])
                continue
            for here, there in taken:
                if x["start"] <= here["start"] and here["start"] + here["length"] <= x["end"]:
                    out = with_interval(out, there["pack"], there["start"], there["start"] + there["length"])
            if x["end"] > cut:
                out = with_interval(out, first, max(x["start"], cut) - cut, x["end"] - cut)
        return out

    off, gone = (cut, n) if row["pack"] == first else (0, 0)
    nodes = [{**x, "parent": place(x["parent"]), "start": x["start"] - off, "body": x["body"] - off, "attend": spans(x["attend"])} for x in row["nodes"][gone:]]
    members = [{"conv_id": m["conv_id"], "leaf": place(m["leaf"]), "spans": spans(m["spans"])} for m in row["members"]]
    return {"pack": row["pack"], "text": row["text"][off:], "nodes": nodes, "members": members}


def format_chats(conversations: DataFrame, loss_role: str = "assistant", pack_tokens: int = 1 << 18, pack_members: int = 4096) -> DataFrame:
    """Packs (pack, text, nodes, members) of conversations (conv_id, turn, role, text).

    A pack is closed when it has reached pack_tokens or pack_members; a single longer conversation stays whole.
    """
    spark = conversations.sparkSession
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("said"))
    said = said.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    convs = said.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    convs = convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    convs = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(TaskContext.get().partitionId(), loss_role)
        for b in batches:
            for i in range(b.num_rows):
                if walk.size >= pack_tokens or len(walk.members) >= pack_members:
                    yield walk.close()
                walk.add(b.column(0)[i].as_py(), [(t["role"], t["text"]) for t in b.column(1)[i].as_py()])
        if walk.members:
            yield walk.close(last=True)

    drafts = materialise(convs.select("conv_id", "turns").mapInArrow(run, DRAFT), "drafts")
    ends = drafts.where("first is not null or last is not null").select("pack", "first", "last").orderBy("pack").collect()  # two rows per task
    edges: list[list] = []
    for r in ends:
        if r["first"] is not None:
            edges.append([[x.asDict() for x in r["first"]], []])
        if r["last"] is not None:
            edges[-1][1] = [x.asDict() for x in r["last"]]
    shared = spark.sparkContext.broadcast(shared_edges([tuple(e) for e in edges]))

    def redirect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if (first := (pack := b.column(0)[i].as_py()) - pack % PACKS) in shared.value:
                    row = {n: b.column(k)[i].as_py() for k, n in enumerate(PACK_ARROW.names)}
                    yield pa.RecordBatch.from_pylist([redirected(row, {first: shared.value[first]})], PACK_ARROW)
                else:
                    yield b.slice(i, 1)

    return drafts.select(*PACK_ARROW.names).mapInArrow(redirect, PACK)


def read_back(packs: DataFrame) -> DataFrame:
    """One row per conversation, from the packs alone. packs: a table (it's read several times).

    Intervals of other packs are fetched first: each distinct one is read once, where it lies, and goes to the packs
    that point to it.
    """
    spans = packs.select("pack", F.explode("members.spans").alias("spans")).select("pack", F.explode("spans").alias("x"))
    asked = materialise(spans.where(F.col("x.pack") != F.col("pack")).select("pack", "x").distinct(), "asked")
    wanted = asked.select(F.col("x.pack").alias("pack"), "x").distinct().groupBy("pack").agg(F.collect_list("x").alias("wanted"))  # no more than a pack has nodes
    piece = f"x {INTERVAL}, said string, loss array<struct<start:int,length:int>>"
    piece_arrow = pa.schema([("x", INTERVAL_ARROW), ("said", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, nodes, some = (b.column(k)[i].as_py() for k in range(3))
                yield pa.RecordBatch.from_pylist([{"x": x, **dict(zip(("said", "loss"), cut_out(text, nodes, x)))} for x in some], piece_arrow)

    holders = join_checked(packs.select("pack", "text", "nodes"), materialise(wanted, "wanted"), "pack", "inner")
    pieces = materialise(holders.select("text", "nodes", "wanted").mapInArrow(fetch, piece), "pieces")
    told = join_checked(asked, pieces, "x", "inner").groupBy("pack").agg(F.collect_list(F.struct("x", "said", "loss")).alias("pieces"))
    full = join_checked(packs.select("pack", "text", "nodes", "members"), materialise(told, "told"), "pack", "left")
    names = [x.split()[0] for x in READ_BACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(read_pack(*(b.column(k)[i].as_py() for k in range(5))))
                cols = [pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*rows))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return full.select("pack", "text", "nodes", "members", "pieces").mapInArrow(run, READ_BACK)


def cut_out(text: str, nodes: list[dict], x: dict) -> tuple[str, list[dict]]:
    """The text of an interval, and the places in it that count for the loss."""
    lo = bisect_left(nodes, x["start"], key=lambda n: n["start"])
    hi = bisect_left(nodes, x["end"], key=lambda n: n["start"])
    return text[x["start"] : x["end"]], [{"start": n["body"] - x["start"], "length": n["body_length"]} for n in nodes[lo:hi] if n["loss"]]


def read_pack(pack: int, text: str, nodes: list[dict], members: list[dict], pieces: list[dict] | None) -> Iterator[tuple]:
    """For each conversation of a pack, what its formatted text says (see READ_BACK)."""
    fetched = {(p["x"]["pack"], p["x"]["start"], p["x"]["end"]): (p["said"], p["loss"]) for p in pieces or ()}
    seen: dict[tuple, tuple] = {}
    for m in members:
        key = tuple((x["pack"], x["start"], x["end"]) for x in m["spans"])
        if key not in seen:
            parts = [cut_out(text, nodes, x) if x["pack"] == pack else fetched[k] for k, x in zip(key, m["spans"])]
            formatted = "".join(t for t, _ in parts)
            turns = [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]
            loss = "".join(unescape(t[s["start"] : s["start"] + s["length"]]) for t, some in parts for s in some)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            seen[key] = (len(turns), sha(said), len(loss), sha(loss), len(formatted))
        yield (m["conv_id"], *seen[key])


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
