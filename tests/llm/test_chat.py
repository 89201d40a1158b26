import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from trackfold.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [*chat.CONTROLS, "\\", "<", "[", "a", " ", "\n", "é中", "<\\s>", "[\\\\/INST]", "<|endoftext|>", "\U0001f600"]


@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(text):
    own = chat.escape(text)
    assert chat.unescape(own) == text
    assert not any(c in own for c in chat.CONTROLS)


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, *chat.PROBE]:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), sha, len(said), hashlib.sha256(said.encode()).hexdigest(), 3 + sum(len(chat.render_turn(r, t)[0]) for r, t in turns)))
    return sorted(out, key=str)


def test_report_equals_brute_force(spark, monkeypatch):
    rng = random.Random(0)
    make = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
    rows = [(rng.randrange(40), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool[/ROLE]", None, ""]), rng.choice([None, make(), make()])) for _ in range(600)]
    rows += [(None, 1, "assistant", "null conversation")] * 2 + [(99, k, "assistant", "x" * 1000 + "\\<s>é") for k in range(400)]
    data = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    for size in (1 << 18, 300):
        monkeypatch.setattr(chat, "PART_CHARS", size)
        assert sorted((tuple(r)[:6] for r in chat.chat_report(data, PATH).collect()), key=str) == brute(rows)
    assert chat.chat_report(data.limit(0), PATH).count() == 1


def test_parts_have_the_tokens_of_the_whole(spark, monkeypatch):
    rows = [(1, k, ["user", "assistant"][k % 2], f"turn {k}. é' \n" * (k % 5)) for k in range(60)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(data, PATH).collect()
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    parts = sorted(chat.format_conversations(data, PATH).collect(), key=lambda r: r.part)
    assert len(whole) == 1 and len(parts) > 5
    assert [i for p in parts for i in p.ids] == list(whole[0].ids)
    assert [x for p in parts for x in p.loss] == list(whole[0].loss)
    assert "".join(p.formatted for p in parts) == whole[0].formatted


def test_mask_by_binary_search():
    offsets = np.array([[0, 2], [2, 3], [3, 3], [3, 6], [6, 9]])
    assert chat.loss_mask(offsets, np.array([[2, 6]])).tolist() == [False, True, True, True, False]
    assert chat.loss_mask(offsets, np.zeros((0, 2))).tolist() == [False] * 5


def test_output_is_read_from_files_in_any_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(chat, "PART_CHARS", 40)
    rows = [(c, k, ["user", "assistant"][k % 2], f"turn {k} of {c}. " * 3) for c in range(6) for k in range(20)]
    chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH).repartition(7, "part").write.parquet(f"{tmp_path}/parts")
    got = sorted(tuple(r)[:6] for r in chat.read_back(spark.read.parquet(f"{tmp_path}/parts")).collect())
    assert got == [r for r in brute(rows) if r[0] != -7]
