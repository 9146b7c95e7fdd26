"""Sequential folds over sorted rows of a key, in bounded memory.

Rows are shuffled by key and sorted by (key, order) once; a task then reads batches in that
order, and a fold carries only its state from row to row, so a long stream is never held
as a whole and many short ones cost no call each.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque, namedtuple
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, key: str, order: list[str], make: Callable[[Any], tuple[Callable, Callable]], schema: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """``make(key)`` gives ``step(row) -> rows`` and ``finish() -> rows``; results are tuples of the schema.
    ``step.state`` has the containers that the fold's state is in, for its streaming form.

    Values are Arrow's: 64-bit integers stay exact. Null is a key like others; rows with a
    null in another column that is not ``nullable`` are passed over. A key's whole order
    is one task's work."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    need = [F.col(c).isNotNull() for c in df.columns if c != key and c not in nullable]
    names, place = df.columns, df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_type = namedtuple("Row", names)
        now, step, finish = object(), None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

        for b in batches:
            out = []
            for row in map(row_type._make, zip(*(c.to_pylist() for c in b.columns))):
                if row[place] != now:
                    out.extend(finish() if finish else ())
                    now = row[place]
                    step, finish = make(now)
                out.extend(step(row))
            if out:
                yield batch(out)
        out = list(finish()) if finish else []
        if out:
            yield batch(out)

    rows = df.where(reduce(lambda x, y: x & y, need)) if need else df
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def density(width: int, limit: int):
    """Windows start at their first row: the first watermark at or past a window's end opens the next."""
    def make(key):
        s = {"start": None, "n": 0, "mark": None}

        def close():
            return [(key, s["start"], s["n"], s["n"] > limit)] if s["start"] is not None else []

        def step(r):
            out = []
            s["mark"] = r.t if s["mark"] is None else max(s["mark"], r.t)
            if s["start"] is None or s["mark"] >= s["start"] + width:
                out = close()
                s["start"], s["n"] = s["mark"], 0
            s["n"] += 1
            return out

        step.state = (s,)
        return step, close
    return make


def floor_windows(width: int, num: int, den: int):
    """Wall-clock windows anchored at their first row, the first one for grace; a later one fails
    if it gained less media than num/den of its length."""
    def make(key):
        s = {"start": None, "media": 0, "first": True}

        def step(r):
            out = []
            if s["start"] is None:
                s["start"] = r.t
            elif r.t >= s["start"] + width:
                elapsed = r.t - s["start"]
                out = [(key, s["start"], elapsed, s["media"], not s["first"] and s["media"] * den < num * elapsed)]
                s.update(start=r.t, media=0, first=False)
            s["media"] += r.media
            return out

        step.state = (s,)
        return step, lambda: []
    return make


def gaps(tolerance: int):
    """An expected clock runs freely from the last anchor: rows within tolerance snap to it, later ones
    are gaps and re-anchor, earlier ones overlap."""
    def make(key):
        s = {"expected": None}

        def step(r):
            if s["expected"] is None:
                s["expected"] = r.t
            off = r.t - s["expected"]
            kind = "gap" if off > tolerance else "overlap" if off < -tolerance else None
            out = [(key, r.arrival, kind, s["expected"], off)] if kind else []
            if kind == "gap":
                s["expected"] = r.t
            if kind != "overlap":
                s["expected"] += r.dur
            return out

        step.state = (s,)
        return step, lambda: []
    return make


def greedy_parts(most: int):
    """Parts close at 85 % of ``most``, or when the next unit would overflow; longer units are errors."""
    def make(key):
        s = {"first": 0, "start": None, "size": 0, "n": 0, "part": 0}

        def close(why):
            if not s["n"]:
                return []
            out = [(key, s["part"], s["start"], s["size"], s["n"], why)]
            s.update(start=None, size=0, n=0, part=s["part"] + 1)
            return out

        def step(r):
            out = []
            if r.dur > most:
                return close("cut") + [(key, s["part"], r.start, r.dur, 1, "oversize")]
            if s["size"] + r.dur > most:
                out = close("overflow")
            if s["start"] is None:
                s["start"] = r.start
            s["size"] += r.dur
            s["n"] += 1
            return out + (close("full") if s["size"] * 100 >= most * 85 else [])

        step.state = (s,)
        return step, lambda: close("end")
    return make


def partition(units: list[tuple[int, bool, bool]], most: int) -> list[int] | None:
    """Lengths of the fewest runs of (size, independent, can end) units; of equally many those with
    longer earlier runs. No run is longer than ``most``, and but for the last one each ends where it
    can and reaches 85 % of it, unless a unit of it is independent. None if there are none."""
    n, none = len(units), float("inf")
    upto, free = [0], [0]
    for size, independent, _ in units:
        upto.append(upto[-1] + size)
        free.append(free[-1] + independent)
    runs, length = [none] * n + [0], [0] * n
    for i in reversed(range(n)):
        for j in range(i + 1, n + 1):
            size = upto[j] - upto[i]
            if size > most:
                break
            whole = size * 100 >= most * 85 or free[j] > free[i]
            if (j == n or (units[j - 1][2] and whole)) and runs[j] < none and runs[j] + 1 <= runs[i]:
                runs[i], length[i] = runs[j] + 1, j - i
    if runs[0] == none:
        return None
    out, i = [], 0
    while i < n:
        out.append(length[i])
        i += length[i]
    return out


def eager(units: list[tuple[int, bool, bool]], most: int) -> list[int] | None:
    """Lengths of runs that close as soon as they reach 85 % or the next unit does not fit; None where
    such a run is too short, or too long for want of an end."""
    out, size, count, free = [], 0, 0, False
    for i, (d, independent, _) in enumerate(units):
        whole, full = size * 100 >= most * 85, size + d > most
        if count and full and not (whole or free):
            return None
        if count and (whole or full) and units[i - 1][2]:
            out.append(count)
            size, count, free = 0, 0, False
        size, count, free = size + d, count + 1, free or independent
        if size > most:
            return None
    return out + [count] if count else out


def planned_parts(most: int):
    """Parts of at most ``most`` whose cuts are confirmed with some foresight: eager runs where they
    are legal, else the fewest that are.

    A cut is final once one more unit has come than showed it, or more than twice ``most`` is held;
    at once where no other could be: the run is one unit that the next does not fit beside, or all
    units are independent. If units cannot end a run everywhere, the next run must be whole as
    well. A segment's end plans what is left, its last run however short. A longer unit, or units
    without a legal partition, end the stream with an error."""
    def make(key):
        s = {"units": [], "shown": None, "segment": None, "part": 0, "bound": False, "dead": False}

        def plan():
            units = [(r.dur, r.independent, r.can_end) for r in s["units"]]
            return (eager(units, most) or partition(units, most)) if units else []

        def take(n):
            rows, s["units"] = s["units"][:n], s["units"][n:]
            s["part"] += 1
            return (key, s["segment"], s["part"] - 1, rows[0].start, sum(r.dur for r in rows), n, None)

        def fail(r, why):
            s["dead"] = True
            return [(key, s["segment"], s["part"], r.start, r.dur, len(s["units"]), why)]

        def final(runs):
            units = s["units"]
            if sum(r.dur for r in units) > 2 * most:
                return True
            if s["bound"]:
                after = units[runs[0] : runs[0] + runs[1]]
                return after[-1].can_end and (sum(r.dur for r in after) * 100 >= most * 85 or any(r.independent for r in after))
            alone = runs[0] == 1 and units[0].dur + units[1].dur > most
            return alone or all(r.independent for r in units) or (s["shown"] is not None and len(units) > s["shown"])

        def flush():
            if s["dead"] or not s["units"]:
                return []
            runs = plan()
            out = [take(n) for n in runs] if runs is not None else fail(s["units"][0], "no_partition")
            s.update(shown=None, part=0, bound=False)
            return out

        def step(r):
            if s["dead"]:
                return []
            out = flush() if s["segment"] not in (None, r.segment) else []
            s["segment"] = r.segment
            if s["dead"]:
                return out
            if r.dur > most:
                return out + fail(r, "too_long")
            s["bound"] = s["bound"] or not r.can_end
            s["units"].append(r)
            while True:
                runs = plan()
                if runs is None:
                    return out + fail(s["units"][0], "no_partition")
                if len(runs) < 2:
                    s["shown"] = None
                    return out
                if not final(runs):
                    s["shown"] = len(s["units"])
                    return out
                out.append(take(runs[0]))
                s["shown"] = None

        step.state = (s,)
        return step, flush
    return make


def drift(width: int, behind: tuple[int, int], well: tuple[int, int]):
    """Edges of falling behind: a window of at least ``width`` since its first row is judged by its last
    one. A stream falls behind if the media it gained are less than ``behind`` of the time the
    window had, without what was withheld of it, and is well again from ``well`` of it on."""
    def make(key):
        s = {"start": None, "media": 0, "held": 0, "behind": False}

        def step(r):
            if s["start"] is None:
                s["start"] = r.t
            s["held"] += r.held
            s["media"] += r.media
            if r.t - s["start"] < width:
                return []
            had, gained = max(0, r.t - s["start"] - s["held"]), s["media"]
            num, den = well if s["behind"] else behind
            now = gained * den < num * had
            edge = now != s["behind"]
            s.update(start=r.t, media=0, held=0, behind=now)
            return [(key, r.arrival, had, gained, now)] if edge else []

        step.state = (s,)
        return step, lambda: []
    return make


def cadence(period: int, tolerance: int, depth: int, strict: bool):
    """Pictures in decode order against a clock that gives one each ``period`` since the first.

    While more than ``depth`` are held, the earliest is judged. Within ``tolerance`` the clock runs
    on as if it had come in time. Later ones are a gap from where they were due, and the clock
    starts from them anew; in strict streams they are an error, as earlier ones always are. An
    error ends the stream: nothing that is held goes on."""
    def make(key):
        held: list = []
        s = {"due": None, "ended": False}

        def judge():
            t, arrival = heapq.heappop(held)
            due = t if s["due"] is None else s["due"]
            off = t - due
            outside = abs(off) > tolerance
            s["ended"] = outside and (strict or off < 0)
            s["due"] = (t if outside else due) + period
            return (key, arrival, "error" if s["ended"] else "gap" if outside else "picture", due, off)

        def step(r):
            if s["ended"]:
                return []
            heapq.heappush(held, (r.t, r.arrival))
            return [judge()] if len(held) > depth else []

        def finish():
            out = []
            while held and not s["ended"]:
                out.append(judge())
            return out

        step.state = (held, s,)
        return step, finish
    return make


def lru(capacity: int):
    """Entries with bytes and an epoch, at most ``capacity`` bytes together. Room for a new one is made of
    entries of another epoch than the newest first, and among equals of the least recently touched.
    A row of an entry that is held touches it, and brings it to the row's epoch."""
    def make(key):
        entries: OrderedDict = OrderedDict()  # least recently touched first
        s = {"epoch": None, "held": 0}

        def step(r):
            s["epoch"] = r.epoch if s["epoch"] is None else max(s["epoch"], r.epoch)
            if r.entry in entries:
                s["held"] -= entries.pop(r.entry)[1]
            out = []
            while entries and s["held"] + r.bytes > capacity:
                victim = next((e for e, (epoch, _) in entries.items() if epoch != s["epoch"]), next(iter(entries)))
                epoch, size = entries.pop(victim)
                s["held"] -= size
                out.append((key, r.arrival, victim, epoch != s["epoch"]))
            entries[r.entry] = r.epoch, r.bytes
            s["held"] += r.bytes
            return out

        step.state = (entries, s,)
        return step, lambda: []
    return make


def takeover(drain: int):
    """Claims of one stream in order: accepted if free, refused while another holds it, taken over once that one drains."""
    def make(key):
        s = {"holder": None, "until": 0}

        def step(r):
            if s["holder"] is None or r.t >= s["until"]:
                verdict = "accepted"
            elif r.ra:
                verdict = "taken_over"
            else:
                return [(key, r.arrival, "already_published")]
            s.update(holder=r.arrival, until=r.t + drain)
            return [(key, r.arrival, verdict)]

        step.state = (s,)
        return step, lambda: []
    return make


def bounded_queue(capacity: int, service: int):
    """One delivery in flight, the rest in order; at capacity the oldest waiting one is evicted."""
    def make(key):
        s = {"free": None, "waiting": deque()}

        def drain(now):
            out = []
            while s["waiting"] and (now is None or s["free"] <= now):
                arrival, t = s["waiting"].popleft()
                begin = max(t, s["free"] if s["free"] is not None else t)
                s["free"] = begin + service
                out.append((key, arrival, "delivered", begin + service - t))
            return out

        def step(r):
            s["free"] = r.t if s["free"] is None else s["free"]
            out = drain(r.t)
            if len(s["waiting"]) >= capacity:
                arrival, t = s["waiting"].popleft()
                out.append((key, arrival, "evicted", r.t - t))
            s["waiting"].append((r.arrival, r.t))
            return out

        step.state = (s,)
        return step, lambda: drain(None)
    return make


def ledger(limit: int):
    """Commitments of a stream in order: refused where they would pass the limit; takeovers may, ends release all."""
    def make(key):
        s = {"held": 0}

        def step(r):
            after = 0 if r.kind == "error" else s["held"] + r.bytes
            refused = after > limit and r.kind not in ("error", "signup")
            if not refused:
                s["held"] = after
            return [(key, r.arrival, s["held"], refused)]

        step.state = (s,)
        return step, lambda: []
    return make


def spill(capacity: int):
    """Rows held in memory until their bytes pass the high mark; then the oldest go until the low one.

    An eighth of the capacity is kept for manifests, a sixteenth parts the marks. The state holds
    the rows in memory, whose bytes the high mark bounds; rows without bytes are not held."""
    high = capacity - capacity // 8 - capacity // 16
    low = high - capacity // 16

    def make(key):
        waiting, s = deque(), {"held": 0}

        def step(r):
            if r.bytes > 0:
                waiting.append((r.arrival, r.bytes))
                s["held"] += r.bytes
            out = []
            if s["held"] > high:
                while s["held"] > low:
                    arrival, size = waiting.popleft()
                    s["held"] -= size
                    out.append((key, arrival, r.arrival, s["held"]))
            return out

        step.state = (waiting, s,)
        return step, lambda: []
    return make


def permits(limit: int):
    """Requests that hold a permit for ``dur``; one that finds ``limit`` held is refused and holds none.

    The state is the ends of the permits held. A permit that ends at a moment is free at it."""
    def make(key):
        ends: list[int] = []

        def step(r):
            while ends and ends[0] <= r.t:
                heapq.heappop(ends)
            admitted = len(ends) < limit
            if admitted:
                heapq.heappush(ends, r.t + r.dur)
            return [(key, r.arrival, 200 if admitted else 503, len(ends))]

        step.state = (ends,)
        return step, lambda: []
    return make
