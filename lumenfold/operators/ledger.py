"""Event ledgers: append-only streams folded into current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import repo_path
from lumenfold.operators.paths import overlapping
from lumenfold.sources.stores import settled


def chain_breaks(events: DataFrame) -> DataFrame:
    """(stream, seq, expected): events whose seq doesn't follow the one before in events(stream, seq)."""
    before = F.lag("seq").over(Window.partitionBy("stream").orderBy("seq"))
    return events.withColumn("expected", before + 1).where(F.col("seq") != F.col("expected")).select("stream", "seq", "expected")


def manifest(events: DataFrame, payload: str = "payload") -> DataFrame:
    """(stream, events, bytes, first_seq, last_seq, tail): tail is the hash of the last payload."""
    return events.groupBy("stream").agg(
        F.count("*").alias("events"), F.sum(F.octet_length(payload)).cast("long").alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.max_by(F.sha2(F.col(payload).cast("binary"), 256), "seq").alias("tail"),
    )


def suffix_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(stream, seq, action): remote events to `append`, or to keep as a `conflict` copy from the first difference on.

    local and remote are (stream, seq, hash).
    """
    r = remote.select("stream", "seq", F.col("hash").alias("_remote"))
    both = r.join(local, ["stream", "seq"])
    split = both.where(F.col("_remote") != F.col("hash")).groupBy("stream").agg(F.min("seq").alias("from_seq"))
    missing = r.join(local, ["stream", "seq"], "left_anti").select("stream", "seq")
    differing = both.where(F.col("_remote") != F.col("hash")).select("stream", "seq")
    rows = missing.unionByName(differing).join(split, "stream", "left")
    return rows.select("stream", "seq", F.when(F.col("seq") >= F.col("from_seq"), "conflict").otherwise("append").alias("action"))


def unread(messages: DataFrame, acks: DataFrame, by: list[str], order: str) -> DataFrame:
    """messages without an ack later in `order` in the same group."""
    last = acks.groupBy(*by).agg(F.max(order).alias("_acked"))
    return messages.join(last, by, "left").where(F.col("_acked").isNull() | (F.col("_acked") < F.col(order))).drop("_acked")


def owned(events: DataFrame, time: list[str]) -> DataFrame:
    """(writer, path, since): claims still held, from events(kind, writer, path, ...) with kind claim, release or resolve.

    A writer holds a path if its last claim is later than its last release of it and than the path's last
    resolve. Both are maxima by key, combined before the shuffle.
    """
    at = F.struct(*time)
    own = events.where(F.col("kind").isin("claim", "release")).groupBy("writer", "path").agg(
        F.max(F.when(F.col("kind") == "claim", at)).alias("claimed"), F.max(F.when(F.col("kind") == "release", at)).alias("released")
    )
    resolved = events.where(F.col("kind") == "resolve").groupBy("path").agg(F.max(at).alias("resolved"))
    held = own.where(F.col("claimed").isNotNull()).join(resolved, "path", "left")
    later = lambda c: F.col(c).isNull() | (F.col(c) < F.col("claimed"))
    return held.where(later("released") & later("resolved")).select("writer", "path", F.col(f"claimed.{time[0]}").alias("since"))


def expired_leases(sessions: DataFrame, as_of: Column, seconds: Column) -> DataFrame:
    """sessions(session, last_seen) whose lease ended before as_of; a null time never expires."""
    return sessions.withColumn("expires_at", F.col("last_seen") + F.make_dt_interval(secs=seconds)).where(F.col("expires_at") < as_of)


def presence(events: DataFrame, by: list[str], time: str, stale_before: Column) -> DataFrame:
    """(by, events, last_seen, stale) of each worker."""
    seen = events.groupBy(*by).agg(F.count("*").alias("events"), F.max(time).alias("last_seen"))
    return seen.withColumn("stale", F.col("last_seen") < stale_before)


def renumbered(events: DataFrame) -> DataFrame:
    """events(stream, ordinal, seq) with new_seq 1..n in file order, and whether that changes the event."""
    n = F.row_number().over(Window.partitionBy("stream").orderBy("ordinal")).cast("long")
    return events.withColumn("new_seq", n).withColumn("changed", ~F.col("seq").eqNullSafe(F.col("new_seq")))


def compacted(events: DataFrame, keep: int = 250) -> DataFrame:
    """events with part `live` for the newest `keep` of each stream, else `archive`."""
    n = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("seq")))
    return events.withColumn("part", F.when(n <= keep, "live").otherwise("archive"))


def link_breaks(events: DataFrame) -> DataFrame:
    """(stream, ordinal, code): events(stream, ordinal, seq, id, prev_id, hash, prev_hash) that don't follow the one before in file order.

    Codes are `sequence`, `previous-id` and `previous-hash`; the first event of a stream must point at nothing.
    """
    w = Window.partitionBy("stream").orderBy("ordinal")
    want = {"sequence": (F.col("seq"), F.coalesce(F.lag("seq").over(w), F.lit(0)) + 1), "previous-id": (F.col("prev_id"), F.lag("id").over(w)), "previous-hash": (F.col("prev_hash"), F.lag("hash").over(w))}
    checks = [F.struct(F.lit(code).alias("code"), ~have.eqNullSafe(expected)) for code, (have, expected) in want.items()]
    rows = events.select("stream", "ordinal", F.array(*[F.struct(c["code"].alias("code"), c["col2"].alias("bad")) for c in checks]).alias("checks"))
    return rows.select("stream", "ordinal", F.inline(F.filter("checks", lambda c: c["bad"]))).select("stream", "ordinal", "code")


def appended(events: DataFrame, drafts: DataFrame) -> DataFrame:
    """(stream, seq, id, prev_id) of drafts(stream, ordinal, id), numbered on from what events(stream, seq, id) has."""
    last = events.groupBy("stream").agg(F.max(F.struct("seq", "id")).alias("last"))
    w = Window.partitionBy("stream").orderBy("ordinal")
    rows = drafts.join(last, "stream", "left").withColumn("k", F.row_number().over(w))
    return rows.select("stream", (F.coalesce("last.seq", F.lit(0)) + F.col("k")).alias("seq"), "id", F.coalesce(F.lag("id").over(w), "last.id").alias("prev_id"))


def open_intents(events: DataFrame, time: list[str]) -> DataFrame:
    """(path, writer, position): queued edit intents, from events(kind, writer, path, ...) with kind intent or claim.

    A writer waits for a path from its first intent after its own last claim of it; a later claim clears it.
    """
    at = F.struct(*time)
    claimed = events.where("kind = 'claim'").groupBy("path", "writer").agg(F.max(at).alias("claimed"))
    waiting = events.where("kind = 'intent'").select("path", "writer", at.alias("at")).join(claimed, ["path", "writer"], "left")
    waiting = waiting.where(F.col("claimed").isNull() | (F.col("at") > F.col("claimed"))).groupBy("path", "writer").agg(F.min("at").alias("since"))
    return waiting.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("since", "writer"))).select("path", "writer", "position")


def owned_by_form(events: DataFrame, time: list[str]) -> DataFrame:
    """(writer, path): claims still held where a resolve may name an `owner` to keep or `owners` to drop.

    events(kind, writer, path, owner, owners, ...): of a path's resolve events, one with an owner drops all others, one
    with owners drops those, one with neither drops all.
    """
    at = F.struct(*time)
    own = events.where(F.col("kind").isin("claim", "release")).groupBy("writer", "path").agg(F.max(F.when(F.col("kind") == "claim", at)).alias("claimed"), F.max(F.when(F.col("kind") == "release", at)).alias("released"))
    own = own.where(F.col("claimed").isNotNull() & (F.col("released").isNull() | (F.col("released") < F.col("claimed"))))
    r = events.where("kind = 'resolve'").select("path", at.alias("at"), "owner", F.when(F.col("owner").isNull(), F.col("owners")).alias("owners"))
    all_out = r.where("owner IS NULL AND owners IS NULL").groupBy("path").agg(F.max("at").alias("all_out"))
    keeping = r.where("owner IS NOT NULL").groupBy("path", "owner").agg(F.max("at").alias("kept"))
    # the last resolve that keeps somebody else: the latest of the path, or the latest with another owner
    ranked = keeping.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("kept")))).where("k <= 2").groupBy("path").agg(
        F.max(F.when(F.col("k") == 1, F.struct("owner", "kept"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("kept"))).alias("b"))
    named = r.where("owners IS NOT NULL").select("path", F.explode("owners").alias("writer"), "at").groupBy("path", "writer").agg(F.max("at").alias("named"))
    j = own.join(all_out, "path", "left").join(ranked, "path", "left").join(named, ["path", "writer"], "left")
    others = F.when(F.col("a.owner") != F.col("writer"), F.col("a.kept")).otherwise(F.col("b"))
    later = lambda c: c.isNull() | (c < F.col("claimed"))
    return j.where(later(F.col("all_out")) & later(others) & later(F.col("named"))).select("writer", "path")


#: Path kinds that one writer holds for the whole repository; the list is our own, as none is published.
SINGLETONS = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|uv\.lock)$|(?:^|/)migrations/|(?:^|/)\.github/workflows/|(?:^|/)generated/contracts/|(?:^|/)release/"
#: Which conflicts stop which operation.
BLOCKING = {
    "inspect": (), "edit": ("global-write-conflict", "write-lock-conflict", "branch-write-conflict"), "commit": ("global-write-conflict", "write-lock-conflict", "branch-write-conflict"),
    "push": ("global-write-conflict", "write-lock-conflict", "branch-write-conflict"), "rebase": ("global-write-conflict", "write-lock-conflict", "branch-write-conflict"),
    "merge": ("global-write-conflict", "write-lock-conflict", "branch-write-conflict", "merge-risk"), "pr_ready": ("global-write-conflict", "write-lock-conflict", "branch-write-conflict", "merge-risk"),
}


def singleton(path: Column) -> Column:
    """Whether a path is of a kind that has one writer for the whole repository."""
    return F.coalesce(path.rlike(SINGLETONS), F.lit(False))


def guard(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """(request_id, kind, conflicts, blocks) of requests(request_id, writer, worktree, branch, operation, path) against claims of others.

    claims(writer, worktree, branch, operation, path); claims to inspect conflict with nothing. Claims are counted by
    path, worktree and branch before the join, so a path that many hold gives one row for each of those, not for each claim.
    """
    by = ["path", "worktree", "branch", "writer"]
    held = claims.where("operation <> 'inspect'").groupBy(*by).agg(F.count("*").alias("n"))
    whole = held.groupBy("path", "worktree", "branch").agg(F.sum("n").alias("n"))
    mine = held.withColumnRenamed("n", "own").select("path", F.col("worktree").alias("w"), F.col("branch").alias("b"), "writer", "own")
    j = requests.join(whole.select("path", F.col("worktree").alias("w"), F.col("branch").alias("b"), "n"), "path").join(mine, ["path", "w", "b", "writer"], "left")
    j = j.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    kind = F.when(singleton(F.col("path")), "global-write-conflict").when(F.col("worktree") == F.col("w"), "write-lock-conflict").when(F.col("branch") == F.col("b"), "branch-write-conflict").otherwise("merge-risk")
    out = j.withColumn("kind", kind).groupBy("request_id", "operation", "kind").agg(F.sum("n").alias("conflicts"))
    blocks = F.lit(False)
    for operation, kinds in BLOCKING.items():
        blocks |= (F.col("operation") == operation) & F.col("kind").isin(*kinds) if kinds else F.lit(False)
    return out.select("request_id", "kind", "conflicts", blocks.alias("blocks"))


def path_errors(claims: DataFrame) -> DataFrame:
    """(claim_id, path, error) of claims(claim_id, paths array) that aren't exact files: a folder, a glob, or the same path twice."""
    one = claims.select("claim_id", F.explode("paths").alias("path")).groupBy("claim_id", "path").agg(F.count("*").alias("n"))
    name = F.element_at(F.split("path", "/"), -1)
    error = F.when(F.col("path").rlike(r"[*?\[\]{}]"), "glob").when(F.endswith("path", F.lit("/")) | ~name.contains("."), "folder").when(F.col("n") > 1, "duplicate")
    return one.withColumn("error", error).where("error IS NOT NULL").select("claim_id", "path", "error")


def health(streams: DataFrame, breaks: DataFrame, blockers: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """(stream, ok, can_inspect, can_lock, can_write, must_wait, must_repair) of streams(stream) with breaks(stream), blockers(stream) and guards(stream, allowed).

    A chain with a break must be repaired before it is inspected, locked or written. A guard's answer, where there is one,
    decides on writing instead, and a denial is one more reason to wait.
    """
    b = breaks.groupBy("stream").agg(F.count("*").alias("breaks"))
    c = blockers.groupBy("stream").agg(F.count("*").alias("blockers"))
    j = streams.select("stream").distinct().join(b, "stream", "left").join(c, "stream", "left")
    j = j.join(guards.groupBy("stream").agg(F.bool_and("allowed").alias("allowed")), "stream", "left") if guards is not None else j.withColumn("allowed", F.lit(None).cast("boolean"))
    repair, blocked, denied = F.col("breaks").isNotNull(), F.col("blockers").isNotNull(), F.coalesce(~F.col("allowed"), F.lit(False))
    return j.select("stream", (~repair & ~denied & ~blocked).alias("ok"), (~repair).alias("can_inspect"), (~repair & ~blocked).alias("can_lock"), F.coalesce("allowed", ~repair).alias("can_write"), (denied | blocked).alias("must_wait"), repair.alias("must_repair"))


def stale_claims(claims: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """(claim_id, action): `resolve` for claims(claim_id, session) whose session(session, expires_at) has expired or is unknown, else `keep`."""
    j = claims.join(sessions.select("session", "expires_at", F.lit(True).alias("_known")), "session", "left")
    return j.select("claim_id", F.when(F.col("_known").isNull() | (F.col("expires_at") < as_of), "resolve").otherwise("keep").alias("action"))


def closeout(claims: DataFrame, lane: str, writers: DataFrame) -> DataFrame:
    """(lane, released, paths, left): what a lane's closeout releases of claims(lane, writer, paths), and what stays of other writers.

    The claims of writers(writer) in the lane are released; the rest must be none for the closeout to be complete.
    """
    c = claims.where(F.col("lane") == lane).join(writers.select("writer", F.lit(True).alias("_mine")).distinct(), "writer", "left")
    mine = F.col("_mine").isNotNull()
    return c.groupBy("lane").agg(F.count_if(mine).alias("released"), F.coalesce(F.sum(F.when(mine, F.size("paths"))), F.lit(0)).cast("long").alias("paths"), F.count_if(~mine).alias("left"))


def last_states(events: DataFrame, by: str, state: str, time: list[str], terminal: tuple[str, ...] = ("done", "cancelled")) -> DataFrame:
    """(by, state, is_open): the last state of each worker or task, and whether that is not a terminal one."""
    last = events.where(F.col(by).isNotNull() & F.col(state).isNotNull()).groupBy(by).agg(F.max_by(state, F.struct(*time)).alias("state"))
    return last.withColumn("is_open", ~F.col("state").isin(*terminal))


def latest_unread(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """(lane, message_id): of messages(lane, message_id, at), each lane's last one that acks(message_id) doesn't have."""
    left = messages.join(acks.select("message_id").distinct(), "message_id", "left_anti")
    return left.groupBy("lane").agg(F.max_by("message_id", F.struct("at", "message_id")).alias("message_id"))


def presence_rows(workers: DataFrame, lanes: DataFrame) -> DataFrame:
    """(worker, lane, state, thread, paths) of each worker with what its lane says, `unknown` where it says nothing."""
    j = workers.join(lanes, "lane", "left")
    return j.select("worker", "lane", F.coalesce("state", F.lit("unknown")).alias("state"), "thread", F.coalesce(F.size(F.filter("paths", lambda p: p != "")), F.lit(0)).alias("paths"))


def blocking_owners(blockers: DataFrame, sentinel: str = "request") -> DataFrame:
    """(request_id, writer, owner) of blockers(request_id, ordinal, writer, owner): the last owner of each writer, the request's own mark left out."""
    return blockers.where(F.col("writer") != sentinel).groupBy("request_id", "writer").agg(F.max_by("owner", "ordinal").alias("owner"))


def next_recipients(intents: DataFrame, releaser) -> DataFrame:
    """(path, lane, writer): who is told of a release: each lane's first intent of intents(path, lane, writer, ordinal), without the releaser."""
    return intents.where(F.col("writer") != releaser).groupBy("path", "lane").agg(F.min_by("writer", "ordinal").alias("writer"))


_HARD = ("global-write-conflict", "write-lock-conflict", "branch-write-conflict")


def conflict_paths(claims: DataFrame) -> DataFrame:
    """(path) that writers of claims(writer, worktree, branch, operation, path) hold against one another: two in a worktree or on a branch, or two at all of a singleton."""
    held = claims.where("operation <> 'inspect'").select("path", "worktree", "branch", "writer").distinct()
    shared = lambda *by: held.groupBy("path", *by).agg(F.countDistinct("writer").alias("n")).where("n > 1").select("path")
    return shared("worktree").unionByName(shared("branch")).unionByName(shared().where(singleton(F.col("path")))).distinct()


def focused_guard(requests: DataFrame, claims: DataFrame, focused: bool = True) -> DataFrame:
    """(request_id, operation, blocked, hard, merge_risks, unowned, global_warnings) of requests(request_id, writer, worktree, branch, operation, path), a row a path.

    A claim concerns a request if its path is the requested one, above it or below it. `hard` and `merge_risks` count
    claims of others that do, by BLOCKING's kinds; `unowned` counts paths that the writer has not claimed in its worktree, which
    a commit must. `global_warnings` counts conflict_paths elsewhere: a focused guard reports them, another blocks on
    them too. To inspect is never blocked: what concerns it is a warning as well.
    """
    claims = claims.withColumn("path", repo_path(F.col("path")))
    requests = requests.withColumn("path", repo_path(F.col("path"))).withColumn("path", F.coalesce("path", F.lit("")))
    held = claims.where("operation <> 'inspect' AND path IS NOT NULL").groupBy("path", "worktree", "branch", "writer").agg(F.count("*").alias("n"))
    whole = held.groupBy("path", "worktree", "branch").agg(F.sum("n").alias("n"))
    paths = lambda rows, side: rows.select(F.lit(0).alias(f"{side}_id"), F.col("path").alias(f"{side}_path")).distinct()
    touching = overlapping(paths(requests, "left"), paths(held, "right")).select(F.col("left_path").alias("path"), F.col("right_path").alias("held"))
    near = requests.join(touching, "path")
    theirs = whole.select(F.col("path").alias("held"), F.col("worktree").alias("w"), F.col("branch").alias("b"), "n")
    mine = held.select(F.col("path").alias("held"), F.col("worktree").alias("w"), F.col("branch").alias("b"), "writer", F.col("n").alias("own"))
    j = near.join(theirs, "held").join(mine, ["held", "w", "b", "writer"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    same = F.col("worktree") == F.col("w")
    kind = F.when(singleton(F.col("held")), _HARD[0]).when(same, _HARD[1]).when(F.col("branch") == F.col("b"), _HARD[2]).otherwise("merge-risk")
    hard = kind != "merge-risk"
    found = j.groupBy("request_id", "path").agg(
        F.sum(F.when(hard, F.col("n")).otherwise(0)).alias("hard"), F.sum(F.when(~hard, F.col("n")).otherwise(0)).alias("merge_risks"), F.bool_or(same & (F.coalesce("own", F.lit(0)) > 0)).alias("owned"))
    clashing = conflict_paths(claims)
    total = clashing.agg(F.count("*")).first()[0]
    here = requests.select("request_id", "path").join(touching.join(clashing.select(F.col("path").alias("held")), "held", "left_semi"), "path").groupBy("request_id").agg(F.countDistinct("held").alias("here"))
    per = requests.select("request_id", "operation", "path").distinct().join(found, ["request_id", "path"], "left").groupBy("request_id", "operation").agg(
        F.sum(F.coalesce("hard", F.lit(0))).alias("hard"), F.sum(F.coalesce("merge_risks", F.lit(0))).alias("merge_risks"), F.count_if(~F.coalesce("owned", F.lit(False))).alias("unowned"))
    elsewhere = F.lit(total) - F.coalesce("here", F.lit(0))
    inspect = F.col("operation") == "inspect"
    stops = lambda kinds: F.col("operation").isin(*[o for o, k in BLOCKING.items() if kinds in k])
    blocked = (stops("write-lock-conflict") & (F.col("hard") > 0)) | (stops("merge-risk") & (F.col("merge_risks") > 0)) | ((F.col("operation") == "commit") & (F.col("unowned") > 0))
    blocked = blocked if focused else blocked | (~inspect & (elsewhere + F.coalesce("here", F.lit(0)) > 0))
    warnings = F.when(inspect, elsewhere + F.col("hard") + F.col("merge_risks")).otherwise(elsewhere)
    return per.join(here, "request_id", "left").select("request_id", "operation", F.coalesce(blocked, F.lit(False)).alias("blocked"), "hard", "merge_risks", "unowned", warnings.cast("long").alias("global_warnings"))


def closeout_matches(lane: str | None = None, writer: str | None = None, node: str | None = None, **context: str) -> Column:
    """Which claims(writer `node.lane`, ...) a closeout is about: those of a lane, writer and node, and with these values in the columns named; None asks for nothing."""
    out = F.lit(True)
    if lane is not None:
        out &= F.regexp_extract("writer", r"^[^.]*\.(.*)$", 1) == lane
    if writer is not None:
        out &= F.col("writer") == writer
    if node is not None:
        out &= F.startswith(F.col("writer"), F.lit(f"{node}."))
    for name, value in context.items():
        out &= F.coalesce(F.col(name) == value, F.lit(False)) if value is not None else F.lit(True)
    return out


def closeout_run(events: DataFrame, time: str, node: str, matches: Column, contexts: DataFrame | None = None) -> DataFrame:
    """One row (initial, released, repaired, remaining, ok): a closeout by `node` on events(kind, writer, path, owner, owners, time).

    The claims that match, by contexts(writer, path, ...) too where given, are released in the name of the node's writers of
    their lanes; the ledger is folded again, what still matches is resolved by owner, and after one more fold nothing
    should be left. A claim of another node is not released but resolved.
    """
    def matching(all_events: DataFrame) -> DataFrame:
        held = owned_by_form(all_events, [time])
        return (held.join(contexts, ["writer", "path"], "left") if contexts is not None else held).where(matches).select("writer", "path")

    columns = {"kind": "string", "writer": "string", "path": "string", "owner": "string", "owners": "array<string>", time: events.schema[time].dataType}
    events = events.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])
    last = events.agg(F.max(time)).first()[0]

    def told(kind: str, rows: DataFrame, after: int, **values: Column) -> DataFrame:
        at = F.lit(last).cast(columns[time]) + (F.expr(f"INTERVAL {after} SECOND") if "time" in str(columns[time]).lower() else after)
        filled = {"kind": F.lit(kind), "path": F.col("path"), time: at, **values}
        return rows.select(*[filled.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    first = settled(matching(events), "closeout-claims")
    own = F.concat(F.lit(f"{node}."), F.regexp_extract("writer", r"^[^.]*\.(.*)$", 1))
    releases = told("release", first.select("path", own.alias("writer")).distinct(), 1, writer=F.col("writer"))
    second = settled(matching(events.unionByName(releases)), "closeout-stale")
    resolves = told("resolve", second.groupBy("path").agg(F.collect_set("writer").alias("owners")), 2, owners=F.col("owners"))
    left = matching(events.unionByName(releases).unionByName(resolves))
    counts = None
    for name, rows in (("initial", first), ("stale", second), ("remaining", left), ("released", releases)):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    n = lambda name: F.max(F.when(F.col("name") == name, F.col("n")))
    return counts.agg(n("initial").alias("initial"), n("released").alias("released"), n("stale").alias("repaired"), n("remaining").alias("remaining")).withColumn("ok", F.col("remaining") == 0)
