import random
from collections import defaultdict
from fractions import Fraction

import pytest
from trawl.llm.mixing import OTHERS, mix, mixed, period_slots, phases

SHARES = {"src0": 5, "src1": 3, "src2": 2}


@pytest.mark.parametrize("shares", [
    {"a": 1}, {"a": 1, "b": 1}, {"a": 2, "b": 1, "c": 1}, {"a": 7, "b": 3, "c": 2, "d": 1}, {f"s{i}": i + 1 for i in range(20)}])
def test_every_source_stays_within_one_block_of_its_target(shares):
    slots, period = period_slots(shares), sum(shares.values())
    assert sorted(s for own in slots.values() for s in own) == list(range(period))
    for name, own in slots.items():
        for t in range(period + 1):
            assert abs(sum(s < t for s in own) - Fraction(t * shares[name], period)) < 1


def test_phases_equal_running_slot_by_slot():
    rng = random.Random(4)
    for _ in range(30):
        shares = {f"s{i}": rng.randrange(1, 9) for i in range(rng.randrange(1, 6))}
        blocks = {name: rng.randrange(0, 40) for name in shares}
        got = {}
        for name, phase, first, last, base, period, slots in phases(blocks, shares):
            for b in range(first, last):
                k = b - first
                got[name, b] = (phase, base + k // len(slots) * period + slots[k % len(slots)])
        left, done, t, phase, want = dict(blocks), dict.fromkeys(blocks, 0), 0, 0, {}
        while any(left.values()):
            active = {n: shares[n] for n in left if left[n]}
            slots, period, start, at = period_slots(active), sum(active.values()), t, defaultdict(int)
            owner = {s: n for n, own in slots.items() for s in own}
            while True:
                name = owner[(t - start) % period]
                want[name, done[name]] = (phase, t)
                done[name] += 1
                left[name] -= 1
                t += 1
                if not left[name]:
                    break
            phase += 1
        assert got == want


def test_blocks_follow_sizes_and_rows_are_all_there(documents, texts):
    rows = mix(documents, SHARES, 10, block=2048).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_stream = defaultdict(list)
    for r in rows:
        by_stream[r.stream].append(r)
    for stream, own in by_stream.items():
        own.sort(key=lambda r: (r.before, r["size"], r.doc_id))
        total = 0
        for r in sorted(own, key=lambda r: r.before):
            assert r.before == total and r["size"] == len(texts[r.doc_id].encode())
            assert r.block == r.before // 2048
            total += r["size"]
        assert [r.slot for r in own] == sorted(r.slot for r in own)
    assert set(by_stream) == {*SHARES, OTHERS}
    assert len({(r.slot, r.stream) for r in rows}) == len({r.slot for r in rows})


def test_emitted_bytes_stay_within_a_block_and_the_longest_row(documents):
    block, every = 512, SHARES | {OTHERS: 10}
    rows = [r for r in mix(documents, SHARES, 10, block=block).collect()]
    first = [r for r in rows if r.phase == 0]
    # Whole blocks of the first phase, which ends when a stream has run out.
    for t in range(max(r.slot for r in first) + 1):
        for name, share in every.items():
            emitted = sum(r["size"] for r in first if r.stream == name and r.slot < t)
            longest = max(r["size"] for r in rows if r.stream == name)
            target = Fraction(t * share * block, sum(every.values()))
            assert -block < emitted - target < block + longest


def test_mixed_rows_come_in_order(documents):
    order = [r.doc_id for r in mixed(documents, SHARES, 10).collect()]
    slots = {r.doc_id: (r.slot, r.before) for r in mix(documents, SHARES, 10).collect()}
    assert sorted(order) == sorted(slots)
    places = [slots[i] for i in order]
    assert places == sorted(places)


def test_odd_rows(odd_docs):
    rows = mix(odd_docs, SHARES, 1, block=64).collect()
    assert len(rows) == odd_docs.count()
    assert {r.stream for r in rows} == {"src0", "src1", "src2", OTHERS}
    kept = mixed(odd_docs, SHARES)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))


def test_no_rows_and_wrong_shares(no_docs):
    assert mix(no_docs, SHARES).collect() == [] and mixed(no_docs, SHARES).collect() == []
    for wrong in ({"a": 0}, {"a": 0.5}, {"a": 20_000}):
        with pytest.raises(ValueError):
            mix(no_docs, wrong)


def test_plan_is_native(documents):
    plan = mix(documents, SHARES)._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
