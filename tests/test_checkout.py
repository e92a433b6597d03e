import random

import pytest

from cleanlake.operators import checkout, removal
from cleanlake.plans.staging import Staging
from cleanlake.policy import DAY, RetentionPolicy

AS_OF = 1_000 * DAY
POLICY = RetentionPolicy()


def file(i, content, name="a.pdf", area="content", days_old=0, size=10):
    created = AS_OF - days_old * DAY
    return (i, content, 1, "user", area, 0, "/", name, size, 1, "x", created, created)


def visit_one_by_one(files, stored, safe=False):
    """What happens when records are visited by id and removed at once."""
    records = {f[0]: f for f in files}
    stored, unlinked, actions = set(stored), set(), {}
    for i in sorted(records):
        content, name, area, created = (records[i][k] for k in (1, 7, 4, 11))
        if content not in stored:
            actions[i] = "content_gone" if content in unlinked else "missing"
        elif name.endswith(".mbz") and created <= AS_OF - POLICY.backup_days * DAY:
            actions[i] = "backup"
            stored.discard(content)
            unlinked.add(content)
        elif (
            area == "draft"
            and created <= AS_OF - POLICY.draft_days * DAY
            and sum(r[1] == content for r in records.values()) == 1
        ):
            actions[i] = "draft"
            stored.discard(content)
            unlinked.add(content)
        else:
            actions[i] = "keep"
            continue
        records = {k: r for k, r in records.items() if k != i}
    return actions, unlinked


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("write", [False, True])
def test_closed_form_equals_one_by_one(spark, table, tmp_path, seed, write):
    rng = random.Random(seed)
    contents = [f"h{n}" for n in range(60)]
    files = []
    for i in rng.sample(range(1, 2000), 400):
        # A third of all records share one content.
        content = "h0" if rng.random() < 1 / 3 else rng.choice(contents)
        if rng.random() < 0.3:
            content = f"own{i}"
        files.append(
            file(
                i,
                content,
                rng.choice(["a.pdf", "a.pdf", "b.mbz"]) if content != "h0" or seed % 2 else "a.pdf",
                rng.choice(["content", "draft"]),
                rng.choice([29, 30, 31]),
            )
        )
    stored = {f[1] for f in files if rng.random() < 0.8}
    if seed == 1:
        stored.discard("h0")
    expected, unlinked = visit_one_by_one(files, stored)

    frame = table("files", files)
    inventory = table("inventory", [(f"filedir/{h}", h, 1) for h in stored])
    options = {"keep": Staging(spark, str(tmp_path)).keep} if write else {}
    args = (frame, inventory, POLICY, AS_OF)

    every = checkout.files_checkout(*args, **options).collect()
    assert {r.id: r.action for r in every} == expected
    doomed = checkout.checkout_doomed(*args, **options).collect()
    assert {r.id: r.action for r in doomed} == {i: a for i, a in expected.items() if a != "keep"}
    assert {r.contenthash for r in checkout.unlink_hashes(*args).collect()} == unlinked
    assert {r.bytes for r in doomed} == {10}


def test_lifetimes_are_inclusive(table):
    files = table(
        "files",
        [file(1, "a", "x.mbz", days_old=30), file(2, "b", "x.mbz", days_old=29),
         file(3, "c", area="draft", days_old=30), file(4, "d", area="draft", days_old=29)],
    )
    inventory = table("inventory", [(h, h, 1) for h in "abcd"])
    got = checkout.files_checkout(files, inventory, POLICY, AS_OF).collect()
    assert {r.id: r.action for r in got} == {1: "backup", 2: "keep", 3: "draft", 4: "keep"}


def test_safe_mode_keeps_content_that_is_still_used(table):
    files = table(
        "files",
        [file(1, "a"), file(2, "a", "x.mbz", days_old=40), file(3, "a"),
         file(4, "b", "x.mbz", days_old=40), file(5, "b", "y.mbz", days_old=40)],
    )
    inventory = table("inventory", [("a", "a", 1), ("b", "b", 1)])
    args = (files, inventory, POLICY, AS_OF)
    got = {r.id: r.action for r in checkout.files_checkout(*args, True).collect()}
    assert got == {1: "keep", 2: "backup", 3: "keep", 4: "backup", 5: "backup"}
    doomed = {r.id for r in checkout.checkout_doomed(*args, True).collect()}
    assert doomed == {2, 4, 5}
    assert [r.contenthash for r in checkout.unlink_hashes(*args, True).collect()] == ["b"]


def test_presence(table):
    files = table("files", [file(1, "a"), file(2, "b")])
    inventory = table("inventory", [("x/a", "a", 1), ("y/a", "a", 1)])
    got = checkout.with_presence(files, inventory).collect()
    assert {(r.id, r.present) for r in got} == {(1, True), (2, False)}


def test_remove_by_file_takes_all_records_of_the_content(spark, table, ids):
    files = table("files", [file(1, "a"), file(2, "a"), file(3, "b"), file(4, "c")])
    chosen = spark.createDataFrame([(1,), (3,), (77,)], "id bigint")
    assert ids(removal.remove_by_file(files, chosen)) == [1, 2, 3]
    inventory = table("inventory", [("a", "a", 1)])
    summary = {r.id: r for r in removal.removal_summary(files, inventory, chosen).collect()}
    assert {i: (r.status, r.n_records) for i, r in summary.items()} == {
        1: ("content", 2),
        3: ("record_only", 1),
        77: ("not_found", 0),
    }


def test_records_stay_when_unlinking_failed(spark, table, ids):
    files = table("files", [file(1, "a"), file(2, "b"), file(3, "c")])
    unlinked = spark.createDataFrame(
        [("a", "error"), ("b", "absent"), ("c", "removed")], "contenthash string, status string"
    )
    assert ids(removal.removable_records(files, unlinked)) == [2, 3]
