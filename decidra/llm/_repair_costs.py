"""The tensors of conversation repairs: costs from each turn to the end by state, and the edits traced through them."""

from __future__ import annotations

import numpy as np

STARTED, SYSTEM, USER, ASSISTANT = range(4)
CODES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state after an inserted or rerolled row, and after a kept row of each initial (-1: it can't be kept).
FORCED = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.full((4, 4), -1)
KEPT[STARTED, SYSTEM], KEPT[[STARTED, SYSTEM, ASSISTANT], USER], KEPT[USER, ASSISTANT] = SYSTEM, USER, ASSISTANT
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
FAR = 1 << 29
#: Costs behind the last row, by state: nothing written, or an assistant's turn last.
DONE = np.array([0, FAR, FAR, 0])
LEGAL = {"su", "ua", "au"}


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """costs (..., 4) if turns may be inserted first: two are enough to reach any state that an insert reaches."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[..., FORCED])
    return costs


def backward_costs(codes: np.ndarray, must: np.ndarray, cut: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, 4): the cost from before each turn to the end, by state.

    codes, must (be deleted) and cut (truncated): (turns, conversations); behind: (conversations, 4), the costs after the last turn.
    """
    turns, n = codes.shape
    out = np.empty((turns + 1, n, 4), np.int32)
    out[turns] = with_inserts(behind)
    for t in range(turns - 1, -1, -1):
        after = out[t + 1]
        kept = KEPT[:, codes[t]].T  # (conversations, 4)
        keep = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), FAR)
        stay = np.minimum(keep, REROLE + after[:, FORCED]) + cut[t][:, None]
        out[t] = with_inserts(np.minimum(np.minimum(DELETE + after, np.where(must[t][:, None], FAR, stay)), FAR))
    return out


def trace(costs: np.ndarray, codes: np.ndarray, must: np.ndarray, cut: np.ndarray, behind: np.ndarray, state: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(each conversation's edits, its state after them) from the states given, by costs of backward_costs."""
    turns, n = codes.shape
    each, at, state = np.arange(n), np.zeros(n, np.int64), state.copy()
    steps: list[np.ndarray] = []
    while True:
        ended = (at == turns) & (behind[each, state] == costs[turns, each, state])
        if ended.all():
            break
        row, last = np.minimum(at, turns - 1), at == turns
        nxt, forced = np.minimum(at + 1, turns), FORCED[state]
        now = costs[at, each, state]
        kept = KEPT[state, codes[row, each]] if turns else forced
        gone, short = (must[row, each], cut[row, each]) if turns else (last, last)
        delete = ~last & (DELETE + costs[nxt, each, state] == now)
        insert = INSERT + costs[at, each, forced] == now
        keep = ~last & ~gone & (kept >= 0) & (short + costs[nxt, each, np.maximum(kept, 0)] == now)
        edit = np.select([ended, delete, insert, keep], [0, ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
        steps.append(edit)
        state = np.select([(edit == 0) | (edit == ord("D")), edit == ord("K")], [state, kept], forced)
        at = at + np.isin(edit, [ord("D"), ord("K"), ord("R")])
    audits = np.stack(steps, 1) if steps else np.zeros((n, 0), np.uint8)
    return [a.tobytes().rstrip(b"\0") for a in audits], state
