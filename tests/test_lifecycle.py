"""Streams that are stopped and started again between batches."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.streaming import lifecycle as L, messages as M

T0 = datetime(2024, 1, 1)
FACT = "event_id string, kind string, source_id string, location_id string, threat_type string, at timestamp, valid_until timestamp"


def fact(event, kind, source, minute, place="p", threat="uav", valid=30):
    return (event, kind, source, place, threat, T0 + timedelta(minutes=minute), T0 + timedelta(minutes=minute + valid) if kind == "assert" else None)


def brute(facts, end):
    """Every event on its own, minute by minute over all facts."""
    out = []
    for event in {f[0] for f in facts}:
        own = sorted((f for f in facts if f[0] == event), key=lambda f: (f[5], f[1], f[2]))
        claims, live = {}, False

        def expire(now):
            nonlocal live
            if live and max(claims.values())[0] <= now:
                out.append((event, "expired", max(claims.values())[0]))
                claims.clear()
                live = False

        for _, kind, source, place, threat, at, valid in own:
            expire(at)
            if kind == "assert":
                until, made = claims.get((source, place, threat), (valid, at))
                claims[source, place, threat] = (max(until, valid), max(made, at))
                if not live:
                    live = True
                    out.append((event, "opened", at))
            else:
                for k in [k for k, v in claims.items() if k[0] == source and place in (None, k[1]) and threat in (None, k[2]) and v[1] <= at]:
                    del claims[k]
                if live and not any(v[0] > at for v in claims.values()):
                    live = False
                    claims.clear()
                    out.append((event, "withdrawn", at))
        expire(end)
    return sorted(out, key=repr)


def run(spark, tmp_path, batches):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for facts in batches:  # each is a start of its own, from the checkpoint of the one before
        spark.createDataFrame(facts, FACT).coalesce(1).write.mode("append").parquet(source)
        M.run_available(L.event_lifecycle(M.message_stream(spark, source, FACT), "5 minutes"), f"file://{tmp_path}/ck", lambda b, _: b.write.mode("append").parquet(target))
    return sorted(((r.event_id, r.status, r.at) for r in spark.read.parquet(target).collect()), key=repr)


END = [fact("late", "assert", "s", 100_000)]


def test_events_open_are_taken_back_and_expire_over_two_restarts(spark, tmp_path):
    batches = [
        [fact("a", "assert", "s1", 0), fact("a", "assert", "s2", 5), fact("b", "assert", "s1", 1), fact("c", "assert", "s1", 0, place="x"), fact("c", "assert", "s1", 2, place="y")],
        [fact("a", "withdraw", "s1", 10), fact("b", "withdraw", "s1", 10, None, None), fact("c", "withdraw", "s1", 12, "x"), fact("b", "assert", "s3", 20)],
        [fact("a", "assert", "s2", 32), fact("d", "assert", "s1", 90)],
        END,
    ]
    got = run(spark, tmp_path, batches)
    m = lambda n: T0 + timedelta(minutes=n)
    want = [("a", "opened", m(0)), ("a", "expired", m(62)), ("b", "opened", m(1)), ("b", "withdrawn", m(10)), ("b", "opened", m(20)), ("b", "expired", m(50)), ("c", "opened", m(0)), ("c", "expired", m(32)), ("d", "opened", m(90)), ("d", "expired", m(120)), ("late", "opened", m(100_000))]
    assert got == sorted(want, key=repr)


def test_any_cut_into_batches_gives_the_same(spark, tmp_path):
    rng, facts = random.Random(11), []
    for minute in range(0, 400, 2):
        kind = rng.choice(("assert", "assert", "withdraw"))
        facts.append(fact(rng.choice("hhhabc"), kind, rng.choice(("s1", "s2")), minute, rng.choice(("x", "y", None) if kind == "withdraw" else ("x", "y")), valid=rng.choice((5, 25))))
    want = brute(facts + END, T0 + timedelta(minutes=100_001))
    assert run(spark, tmp_path, [facts[:70], facts[70:71], facts[71:], END]) == want
    assert {s for _, s, _ in want} == {"opened", "withdrawn", "expired"}


LOG = "id long, text string"


def test_a_fan_out_goes_on_where_it_has_written(spark, tmp_path):
    """A batch that fails after its rows and before the cursor, then a checkpoint that is lost."""
    source, target = f"file://{tmp_path}/log", f"file://{tmp_path}/fan"
    chats = spark.createDataFrame([(c,) for c in "xyz"], "chat string")
    out = L.FanOut(spark, target, lambda rows: rows.join(chats, ~(rows.text.contains("-") & (chats.chat == "z"))).select("id", "chat"))
    delivered = lambda: sorted((r.id, r.chat) for r in out.deliveries("id long, chat string").collect())
    assert out.position() == -1
    put = lambda *ids: spark.createDataFrame([(i, "-" if i % 2 else "+") for i in ids], LOG).coalesce(1).write.mode("append").parquet(source)
    go = lambda checkpoint: M.run_available(M.message_stream(spark, source, LOG), f"file://{tmp_path}/{checkpoint}", out.write)
    put(0, 1, 2)
    go("ck")
    assert out.position() == 2
    put(3, 4)
    moved, out.moved = out.moved, lambda last: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(Exception, match="stopped"):
        go("ck")
    out.moved = moved
    put(5)
    go("ck")
    want = sorted((i, c) for i in range(6) for c in ("xy" if i % 2 else "xyz"))
    assert delivered() == want and out.position() == 5
    put(6)
    go("lost")
    assert delivered() == sorted([*want, (6, "x"), (6, "y"), (6, "z")])
    go("lost")
    assert out.position() == 6 and len(delivered()) == 18
