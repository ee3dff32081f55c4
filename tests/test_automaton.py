"""The automaton against plain search, also where texts are cut into lanes."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from textloom.functions import automaton
from textloom.functions.automaton import Automaton


@pytest.mark.parametrize("lane", [3, 7, 512])
def test_finds_what_contains_finds(monkeypatch, lane):
    monkeypatch.setattr(automaton, "LANE", lane)
    rng = random.Random(lane)
    for _ in range(150):
        letters = "abé日𝄞"[: rng.randint(1, 5)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))]
        texts = ["".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 60))) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 20))]
        a = Automaton(words)
        rows, found = a.find(pa.array(texts, pa.string()))
        assert list(zip(rows.tolist(), found.tolist())) == [(x, y) for x, t in enumerate(texts) if t for y, w in enumerate(a.words) if w in t]


def test_slices_and_long_texts():
    texts = pa.array(["skip", "é" * 100_000 + "needle" + "日" * 50_000 + "need", None, "needle"])[1:]
    rows, found = Automaton(["needle", "need", "é日"]).find(texts)
    assert list(zip(rows.tolist(), found.tolist())) == [(0, 0), (0, 1), (2, 0), (2, 1)]
