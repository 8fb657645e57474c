"""The event automaton and the merge as a transition table, used as the reference in tests."""

# (phase, start row?, good row?) -> (next phase, action); rows in stream order
TABLE = {
    ("idle", True, True): ("open", "begin"), ("idle", True, False): ("open", "begin"),
    ("idle", False, True): ("idle", None), ("idle", False, False): ("idle", None),
    ("open", True, True): ("running", "take"), ("open", False, True): ("running", "take"),
    ("open", True, False): ("open", None), ("open", False, False): ("open", None),
    ("running", True, True): ("running", "take"), ("running", False, True): ("running", "take"),
    ("running", True, False): ("idle", "end"), ("running", False, False): ("idle", "end"),
}


def fold_events(rows):
    """rows: (ts_ms, speed, acc_actual, acc_event, start_event) of one key in stream order."""
    phase, taken, head, out = "idle", [], None, []
    for before, row in zip([None, *rows], rows):
        ts, speed, _, rate, start = row
        good = before is not None and ts - before[0] < 1000 and (rate >= 0 or speed >= 4)
        phase, action = TABLE[phase, start == 1, good]
        if action == "begin":
            head, taken = row, []
        elif action == "take":
            taken.append(row)
        elif action == "end":
            out.append((head[0], taken[-1][0], head[1], max([0.0] + [r[2] for r in taken]), max([0.0] + [r[1] for r in taken])))
    return out


def fold_merge(events, gap_ms=500):
    """events: (ts_start, ts_end, v_init, max_acc, max_speed) of one key in order; the last group stays open."""
    groups = []
    for e in (e for e in events if e[1] > e[0]):
        if groups and e[0] - groups[-1][-1][1] < gap_ms:
            groups[-1].append(e)
        else:
            groups.append([e])
    return [(g[0][0], g[-1][1], g[0][2], max(e[3] for e in g), max(e[4] for e in g)) for g in groups[:-1]]
