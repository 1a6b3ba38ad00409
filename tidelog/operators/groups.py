"""Consumer groups: assignment of partitions to members, choice of leader and protocol, expiry, and the coordinator's state machine.

Members (group_id, member_id, topic: a row per subscription) and partitions (topic, partition_id) are metadata: their number
follows that of consumers and partitions, not that of records.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.common import chunked_lag, chunked_running_sum, ship

SESSION_MS = 10_000


def assign_range(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Contiguous blocks per topic over the members that want it, the remainder to the first members."""
    by = W.partitionBy("group_id", "topic")
    ranked = members.select("group_id", "member_id", "topic").distinct().withColumns({"m": F.row_number().over(by.orderBy("member_id")) - 1, "n": F.count(F.lit(1)).over(by)})
    listed = partitions.select("topic", "partition_id").distinct()
    numbered = listed.withColumns({"i": F.row_number().over(W.partitionBy("topic").orderBy("partition_id")) - 1, "k": F.count(F.lit(1)).over(W.partitionBy("topic"))})
    each, extra = F.floor(F.col("k") / F.col("n")), F.col("k") % F.col("n")
    long = (each + 1) * extra
    owner = F.when(F.col("i") < long, F.floor(F.col("i") / (each + 1))).otherwise(extra + F.floor((F.col("i") - long) / F.greatest(each, F.lit(1))))
    sizes = ranked.select("group_id", "topic", "n").distinct().join(numbered, "topic").withColumn("m", owner.cast("int"))
    return sizes.join(ranked.drop("n"), ["group_id", "topic", "m"]).select("group_id", "member_id", "topic", "partition_id")


def assign_round_robin(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Partitions of all topics in order, dealt to the members in turn; for groups whose members all have the same subscription."""
    who = members.select("group_id", "member_id").distinct()
    ranked = who.withColumns({"m": F.row_number().over(W.partitionBy("group_id").orderBy("member_id")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("group_id"))})
    wanted = members.select("group_id", "topic").distinct().join(partitions.select("topic", "partition_id").distinct(), "topic")
    dealt = wanted.withColumn("i", F.row_number().over(W.partitionBy("group_id").orderBy("topic", "partition_id")) - 1)
    return dealt.join(ranked.select("group_id", "n").distinct(), "group_id").withColumn("m", F.col("i") % F.col("n")).join(ranked.drop("n"), ["group_id", "m"]).select("group_id", "member_id", "topic", "partition_id")


def deal(wants: dict[str, set[str]], counts: dict[str, list[int]]) -> list[tuple[str, str, int]]:
    """Round robin with unequal subscriptions: the turn goes on across topics and passes those who don't want the topic."""
    order, turn, out = sorted(wants), 0, []
    for topic in sorted(counts):
        if not any(topic in w for w in wants.values()):
            continue
        for p in sorted(counts[topic]):
            while topic not in wants[order[turn % len(order)]]:
                turn += 1
            out.append((order[turn % len(order)], topic, p))
            turn += 1
    return out


def assign_unequal(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Round robin for any subscriptions; a group is one sequential walk over its partitions."""
    ship(members.sparkSession)
    listed = partitions.groupBy("topic").agg(F.sort_array(F.collect_set("partition_id")).alias("ids"))
    rows = members.select("group_id", "member_id", "topic").distinct().join(listed, "topic")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wants = pdf.groupby("member_id")["topic"].agg(set).to_dict()
        counts = {t: list(ids) for t, ids in zip(pdf["topic"], pdf["ids"], strict=True)}
        return pd.DataFrame([(key[0], *x) for x in deal(wants, counts)], columns=["group_id", "member_id", "topic", "partition_id"])

    return rows.groupBy("group_id").applyInPandas(walk, "group_id string, member_id string, topic string, partition_id int")


ASSIGNORS = {"range": assign_range, "roundrobin": assign_round_robin, "roundrobin-unequal": assign_unequal}


def leaders(members: DataFrame) -> DataFrame:
    """Leader (smallest member id) and protocol (first of the leader's list that every member has, else empty) of each group.

    ``members``: group_id, member_id, protocols.
    """
    heads = members.groupBy("group_id").agg(F.min("member_id").alias("leader_id"), F.min_by("protocols", "member_id").alias("wanted"), F.count(F.lit(1)).alias("n"))
    had = members.select("group_id", F.explode(F.array_distinct("protocols")).alias("protocol")).groupBy("group_id", "protocol").agg(F.count(F.lit(1)).alias("has"))
    tried = heads.select("group_id", "n", F.posexplode("wanted").alias("at", "protocol")).join(had, ["group_id", "protocol"]).where("has = n")
    chosen = tried.groupBy("group_id").agg(F.min_by("protocol", "at").alias("protocol"))
    return heads.select("group_id", "leader_id", F.col("n").alias("n_members")).join(chosen, "group_id", "left").withColumn("protocol", F.coalesce("protocol", F.lit("")))


def expiry(heartbeats: DataFrame, now_ms: int, timeout_ms: int = SESSION_MS) -> DataFrame:
    """Members whose last heartbeat (group_id, member_id, ts_ms) is ``timeout_ms`` old, and the longest silence each had before."""
    once = heartbeats.select("group_id", "member_id", "ts_ms").distinct()
    lagged = chunked_lag(once, ["group_id", "member_id"], "ts_ms", F.col("ts_ms"), "before_ms", 86_400_000)  # chunks of a day
    silence = F.col("ts_ms") - F.col("before_ms")
    seen = lagged.groupBy("group_id", "member_id").agg(F.max("ts_ms").alias("last_ms"), F.coalesce(F.max(silence), F.lit(0)).alias("longest_silence_ms"))
    return seen.withColumn("expired", F.lit(now_ms) - F.col("last_ms") >= timeout_ms)


# The coordinator: one group is one value, changed by one event at a time.

NONE, ILLEGAL_GENERATION, UNKNOWN_MEMBER, REBALANCING, INVALID_GROUP = 0, 12, 13, 14, 15
EMPTY, PREPARING, COMPLETING, STABLE = "empty", "preparing", "completing", "stable"
#: Stands for: rebalancing if the group still waits for members after the event, else no error.
WAITING = -1


@dataclass
class Member:
    topics: list[str]
    protocols: list[str]
    timeout_ms: int
    heard_ms: int
    joined: bool = True
    assignment: str = ""


@dataclass
class Event:
    """What a member asks. ``member`` is empty for one that has no id yet, who gets ``client`` and ``issued``."""

    op: str
    now_ms: int
    member: str = ""
    client: str = ""
    issued: int = 0
    generation: int = -1
    topics: list[str] = field(default_factory=list)
    protocols: list[str] = field(default_factory=list)
    timeout_ms: int = SESSION_MS
    assignments: dict[str, str] = field(default_factory=dict)


@dataclass
class Group:
    """State of a group: empty, preparing (waiting for members to join again), completing (waiting for the leader's
    assignment) or stable. A group without members is forgotten: the next one of its name is new."""

    state: str = EMPTY
    generation: int = 0
    leader: str = ""
    protocol: str = ""
    members: dict[str, Member] = field(default_factory=dict)

    # ---- what is asked of the state

    def stranger(self, e: Event) -> bool:
        return e.member not in self.members and not (e.op == "join" and not e.member)

    def stale(self, e: Event) -> bool:
        return e.generation != self.generation

    def asks_again(self, e: Event) -> bool:
        m = self.members.get(e.member)
        return m is not None and m.joined and (m.topics, m.protocols) == (e.topics, e.protocols)

    def follower(self, e: Event) -> bool:
        return e.member != self.leader

    # ---- what is done to it

    def hear(self, e: Event) -> None:
        self.members[e.member].heard_ms = e.now_ms

    def enter(self, e: Event) -> None:
        e.member = e.member or f"{e.client}-{e.issued}"
        had = self.members.get(e.member)
        self.members[e.member] = Member(e.topics, e.protocols, e.timeout_ms if e.timeout_ms > 0 else SESSION_MS, e.now_ms, True, had.assignment if had else "")

    def remove(self, e: Event) -> None:
        del self.members[e.member]

    def assign(self, e: Event) -> None:
        for who, what in e.assignments.items():
            if who in self.members:
                self.members[who].assignment = what
        self.state = STABLE

    def prepare(self, e: Event) -> None:
        self.state = PREPARING
        for m in self.members.values():
            m.joined = False

    def settle(self, e: Event) -> None:
        """When all have joined: a new generation, its leader and protocol. When nobody is left: nothing is."""
        if not self.members:
            self.state, self.generation, self.leader, self.protocol = EMPTY, 0, "", ""
        elif all(m.joined for m in self.members.values()):
            self.generation += 1
            self.leader = min(self.members)
            shared = [p for p in self.members[self.leader].protocols if all(p in m.protocols for m in self.members.values())]
            self.protocol, self.state = shared[0] if shared else "", COMPLETING

    def expire(self, now_ms: int) -> list[str]:
        gone = [k for k, m in self.members.items() if now_ms - m.heard_ms >= m.timeout_ms]
        for k in gone:
            del self.members[k]
        if gone:
            self.prepare(Event("expire", now_ms))
            self.settle(Event("expire", now_ms))
        return gone

    def deadline_ms(self) -> int | None:
        """When the next member will have been silent too long."""
        return min((m.heard_ms + m.timeout_ms for m in self.members.values()), default=None)

    def take(self, e: Event) -> int:
        """One event, by the first of the RULES that holds; its error code."""
        for op, states, test, error, actions in RULES:
            if op == e.op and self.state in (states or ANY) and (test is None or test(self, e)):
                for act in actions:
                    act(self, e)
                return (REBALANCING if self.state == PREPARING else NONE) if error == WAITING else error
        return NONE  # a tick: only time passes

    def dumps(self) -> str:
        return json.dumps(self, default=vars)

    @classmethod
    def loads(cls, text: str) -> Group:
        value = json.loads(text)
        members = {k: Member(**m) for k, m in value.pop("members").items()}
        return cls(**value, members=members)


ANY = (EMPTY, PREPARING, COMPLETING, STABLE)
#: Event, states (None: all), condition, error code and actions. The first rule that holds is taken.
RULES = [
    ("join", None, Group.stranger, UNKNOWN_MEMBER, ()),
    ("join", (COMPLETING, STABLE), Group.asks_again, NONE, (Group.hear,)),
    ("join", (PREPARING,), None, WAITING, (Group.enter, Group.settle)),
    ("join", None, None, WAITING, (Group.prepare, Group.enter, Group.settle)),
    ("leave", None, Group.stranger, UNKNOWN_MEMBER, ()),
    ("leave", None, None, NONE, (Group.remove, Group.prepare, Group.settle)),
    *[
        rule
        for op in ("sync", "heartbeat")
        for rule in (
            (op, None, Group.stranger, UNKNOWN_MEMBER, ()),
            (op, None, Group.stale, ILLEGAL_GENERATION, ()),
            (op, (PREPARING,), None, REBALANCING, ()),
        )
    ],
    ("sync", (COMPLETING,), Group.follower, REBALANCING, (Group.hear,)),
    ("sync", (COMPLETING,), None, NONE, (Group.hear, Group.assign)),
    ("sync", None, None, NONE, (Group.hear,)),
    ("heartbeat", None, None, NONE, (Group.hear,)),
]

EVENTS = (
    "seq bigint, group_id string, op string, member_id string, client_id string, issued bigint, generation int, topics array<string>, protocols array<string>, timeout_ms int, ts_ms bigint, "
    "assignments map<string,string>"
)
RESULTS = "seq bigint, group_id string, op string, member_id string, error int, generation int, state string, n_members int, leader string, protocol string, assignment string, members array<string>"


def names(schema: str) -> list[str]:
    """Column names of a schema text without nested commas."""
    return [c.split()[0] for c in schema.split(", ")]


def issue(events: DataFrame) -> DataFrame:
    """Events with ``issued``: the numbers, from 1 over all groups in the order of ``seq``, of joins without a member id; 0 for the rest."""
    new = (F.col("op") == "join") & (F.coalesce("member_id", F.lit("")) == "") & (F.coalesce("group_id", F.lit("")) != "")
    marked = events.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("__all", F.lit(0))
    summed = chunked_running_sum(marked, ["__all"], "seq", "__new", "__earlier")
    return summed.withColumn("issued", F.when(F.col("__new") == 1, F.col("__earlier") + 1).otherwise(0)).drop("__new", "__all", "__earlier")


def apply_event(group: Group, e) -> tuple:
    """One event on a group: the row of its result, with what the asking member is told (its assignment on a sync, the members on a join if it leads)."""
    now, who = int(e.ts_ms), e.member_id or ""
    if not e.group_id:
        return (e.seq, e.group_id, e.op, who, INVALID_GROUP, 0, EMPTY, 0, "", "", "", [])
    group.expire(now)
    many = lambda v: [] if v is None else list(v)
    asked = Event(e.op, now, who, e.client_id or "", int(e.issued), int(e.generation), many(e.topics), many(e.protocols), int(e.timeout_ms), dict(e.assignments or {}))
    error = group.take(asked)
    told = group.members[asked.member].assignment if e.op == "sync" and not error else ""
    list_ = sorted(group.members) if e.op == "join" and not error and asked.member == group.leader else []
    return (e.seq, e.group_id, e.op, asked.member, error, group.generation, group.state, len(group.members), group.leader, group.protocol, told, list_)


def replay_events(events: DataFrame) -> DataFrame:
    """Run the coordinator over recorded events (EVENTS, ``issued`` is given here), group by group in the order of ``seq``; a group's events are streamed
    through one state, sorted by the shuffle."""
    ship(events.sparkSession)

    def run(parts):
        from tidelog.operators import groups as g

        place, group = None, g.Group()
        for part in parts:
            out = []
            for e in part.itertuples():
                if e.group_id != place:
                    place, group = e.group_id, g.Group()
                out.append(g.apply_event(group, e))
            yield pd.DataFrame(out, columns=g.names(g.RESULTS))

    numbered = issue(events.drop("issued")).select(*names(EVENTS))
    return numbered.repartition("group_id").sortWithinPartitions("group_id", "seq").mapInPandas(run, RESULTS)
