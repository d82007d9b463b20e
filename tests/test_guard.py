"""The focused guard on small ledgers."""

from lumenfold.operators import ledger

CLAIM = "writer string, worktree string, branch string, operation string, path string"
REQUEST = "request_id int, " + CLAIM


def guard(spark, requests, claims, **how):
    rows = ledger.focused_guard(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(claims, CLAIM), **how).collect()
    return {r.request_id: (r.blocked, r.hard, r.merge_risks, r.unowned, r.global_warnings) for r in rows}


BUSY = [("b", "w", "main", "edit", "other/busy.ts"), ("c", "w", "main", "edit", "other/busy.ts")]


def test_only_requested_paths_block_a_focused_guard(spark):
    claims = [("a", "w", "main", "edit", "src/owned.ts"), *BUSY]
    request = [(1, "a", "w", "main", "edit", "src/owned.ts")]
    assert guard(spark, request, claims) == {1: (False, 0, 0, 0, 1)}
    assert guard(spark, request, claims, focused=False) == {1: (True, 0, 0, 0, 1)}


def test_inspect_warns_and_commit_needs_a_claim_in_the_worktree(spark):
    claims = [("a", "w", "main", "edit", "./src/Lib.rs"), ("b", "w", "main", "inspect", "src/lib.rs")]
    requests = [(1, "b", "w", "main", "inspect", "src/lib.rs"), (2, "b", "w", "main", "commit", "src/lib.rs"), (3, "a", "w", "main", "commit", "src/lib.rs"), (4, "a", "elsewhere", "main", "commit", "src/lib.rs"), (5, "b", "w", "main", "commit", "src/free.rs")]
    assert guard(spark, requests, claims) == {1: (False, 1, 0, 1, 1), 2: (True, 1, 0, 1, 0), 3: (False, 0, 0, 0, 0), 4: (True, 0, 0, 1, 0), 5: (True, 0, 0, 1, 0)}


def test_folders_branches_singletons_and_several_paths(spark):
    claims = [("x", "w1", "one", "edit", "src"), ("y", "w2", "two", "edit", "a/yarn.lock")]
    requests = [(1, "z", "w1", "zz", "edit", "src/deep/f.ts"), (2, "z", "w3", "one", "edit", "src/f.ts"), (3, "z", "w3", "three", "edit", "src/f.ts"), (3, "z", "w3", "three", "edit", "b.ts"), (4, "z", "w3", "three", "pr_ready", "src/f.ts"), (5, "z", "w9", "nine", "edit", "a"), (6, "z", "w", "b", "edit", None)]
    assert guard(spark, requests, claims) == {1: (True, 1, 0, 1, 0), 2: (True, 1, 0, 1, 0), 3: (False, 0, 1, 2, 0), 4: (True, 0, 1, 1, 0), 5: (True, 1, 0, 1, 0), 6: (False, 0, 0, 1, 0)}
    assert guard(spark, requests, []) == {k: (False, 0, 0, 2 if k == 3 else 1, 0) for k in range(1, 7)}


EVENT = "kind string, writer string, path string, owner string, owners array<string>, at int"


def test_closeout_releases_own_claims_and_resolves_the_others(spark):
    events = [("claim", "n1.a", "x", None, None, 1), ("claim", "n2.a", "x", None, None, 2), ("claim", "n1.b", "y", None, None, 3), ("claim", "n1.a", "z", None, None, 4), ("release", "n1.a", "z", None, None, 5)]
    e = spark.createDataFrame(events, EVENT)
    one = lambda df: tuple(df.first())
    assert one(ledger.closeout_run(e, "at", "n1", ledger.closeout_matches(lane="a"))) == (2, 1, 1, 0, True)
    assert one(ledger.closeout_run(e, "at", "n1", ledger.closeout_matches(lane="a", node="n1"))) == (1, 1, 0, 0, True)
    assert one(ledger.closeout_run(e, "at", "n1", ledger.closeout_matches())) == (3, 2, 1, 0, True)
    assert one(ledger.closeout_run(e, "at", "n1", ledger.closeout_matches(lane="none"))) == (0, 0, 0, 0, True)
    contexts = spark.createDataFrame([("n1.a", "x", "t1"), ("n1.b", "y", "t2")], "writer string, path string, thread string")
    assert one(ledger.closeout_run(e, "at", "n1", ledger.closeout_matches(thread="t2"), contexts)) == (1, 1, 0, 0, True)
