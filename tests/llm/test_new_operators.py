"""Hard negatives, language identification and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_whole_tables import FOLDER, answer

from runlens.llm import conversation_repair as R
from runlens.llm import hard_negatives as H
from runlens.llm import language_id as L

# --- hard negatives ------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [3, 200, 40_000, 1 << 20, 1 << 29])
def test_packed_products_are_exact(most):
    random = np.random.default_rng(most)
    for n, m, dim in ((3, 17, 5), (1, 1, 1), (300, 50, 64), (2, 9, 0)):
        a = random.integers(-most, most, (n, dim))
        b = random.integers(-most // 3, most, (m, dim))
        found = np.zeros((n, m), np.int64)
        for at, part in H.product_blocks(a, b):
            found[at:at + len(part)] = part
        assert (found == a @ b.T).all()


def test_several_candidates_share_a_word():
    rows = np.random.default_rng(0).integers(-100, 100, (50, 64))
    width = H.field_width(H.biased(rows)[0], H.biased(rows)[0])
    held = H.packed(rows, width)
    assert held.fields >= 2 and held.words.shape == (64, -(-50 // held.fields))


def mined(rows: list[dict]) -> list[tuple]:
    """Every row scored against every anchor; rows of vec_id, embedding and label."""
    usable = []
    for row in rows:
        vector, key, label = row["embedding"], row["vec_id"], row["label"]
        if None in (vector, key, label) or not all(x is not None and np.isfinite(x)
                                                    for x in vector):
            continue
        units = [int(np.floor(256 * float(x))) for x in vector]
        usable.append((key, (label + 1) % 10 if key % 7 == 0 else label, units))
    out = []
    asked = {}
    for key, label, units in usable:
        if key % 100 == 0:
            asked[key] = min(asked.get(key, (label, units)), (label, units))
    for key, (label, units) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(units, other)), k, same_label == label)
                        for k, same_label, other in usable
                        if k != key and len(other) == len(units))
        for p, positive, _ in [x for x in scored if x[2]][:5]:
            fits = [(n, k) for n, k, same in scored if not same
                    and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(key, positive, rank, k, -p, -n) for rank, (n, k) in enumerate(fits, 1)]
    return sorted(out)


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives(spark):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    found = answer(spark, "op11_hard_negatives")
    assert sorted(tuple(row[name] for name in NEGATIVE) for row in found) == mined(rows)
    assert found


def odd_vectors() -> list[dict]:
    random = np.random.default_rng(4)
    rows = [{"vec_id": int(i), "embedding": random.integers(-3, 4, 6) / 8, "label": int(i % 3)}
            for i in range(0, 420)]
    rows = [{**row, "embedding": row["embedding"].tolist()} for row in rows]
    rows += rows[100:130] + rows[7:9] * 3  # repeated rows and an anchor's own copy
    rows += [{"vec_id": 500, "embedding": None, "label": 1},
             {"vec_id": 600, "embedding": [1.0, None, 0.0, 0.0, 0.0, 0.0], "label": 1},
             {"vec_id": 700, "embedding": [float("nan")] * 6, "label": 1},
             {"vec_id": 800, "embedding": [0.5] * 6, "label": None},
             {"vec_id": None, "embedding": [0.5] * 6, "label": 1},
             {"vec_id": 900, "embedding": [0.5, 0.25], "label": 1},
             {"vec_id": 901, "embedding": [0.5, 0.125], "label": 1},
             {"vec_id": 902, "embedding": [0.25, 0.125], "label": 2},
             {"vec_id": 1000, "embedding": [], "label": 2}]
    return [{"label_": "x", "dim": 1, "id": None, **row} for row in rows]


def mine(spark, rows, **options):
    table = spark.createDataFrame(
        [tuple(row.values()) for row in rows],
        "label_ string, dim int, id string, vec_id long, embedding array<double>, label int")
    key = F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = H.hard_negatives(table, key % 100 == 0, label, 256.0, **options)
    return sorted(tuple(row) for row in found.select(*NEGATIVE).collect())


def test_hard_negatives_of_odd_rows_in_any_blocks(spark):
    rows = odd_vectors()
    wanted = mined(rows)
    assert wanted and mine(spark, rows) == wanted
    assert mine(spark, rows, block=50, column=2) == wanted
    assert mine(spark, []) == []


# --- language ------------------------------------------------------------------------------------

def walked(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Chance of each state at each word, from every path."""
    n, states = emission.shape
    total = np.zeros((n, states))
    for path in itertools.product(range(states), repeat=n):
        weight = emission[0, path[0]] * transition[:, path[0]].sum()
        for at in range(1, n):
            weight *= transition[path[at - 1], path[at]] * emission[at, path[at]]
        for at, state in enumerate(path):
            total[at, state] += weight
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("chunk", [1, 2, 3, 64])
def test_forward_backward_equals_all_paths(chunk):
    random = np.random.default_rng(3)
    sizes = np.array([1, 7, 2, 5])
    emission, transition = random.random((15, 3)) + 0.01, random.random((3, 3)) + 0.01
    found = L.chances(emission, sizes, transition, chunk)
    wanted = [walked(part, transition) for part in np.split(emission, np.cumsum(sizes)[:-1])]
    assert np.allclose(found, np.concatenate(wanted))


def test_long_chains_do_not_vanish():
    random = np.random.default_rng(5)
    emission = random.random((200_000, 4)) * 1e-6 + 1e-9
    found = L.chances(emission, np.array([200_000]), np.eye(4) + 0.01)
    assert np.isfinite(found).all() and np.allclose(found.sum(axis=1), 1)


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_language_of_held_out_documents(spark, documents):
    lang = {row["doc_id"]: row["lang"] for row in documents}
    rows = answer(spark, "op12_language_id")
    assert len(rows) == len(documents)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
    held = [row for row in rows if row.held_out]
    assert sum(row.lang_pred == lang[row.doc_id] for row in held) >= 0.97 * len(held)


def test_words_of_code_switched_text(model, documents):
    """Twenty words of one language, twenty of another, from documents never learned from."""
    held = defaultdict(list)
    for row in documents:
        if zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2:
            held[row["lang"]] += L.words_of(row["text"])[:20]
    labeller, right, total = L.Labeller(model), 0, 0
    for a, b in itertools.permutations([x for x in model.languages if len(held[x]) >= 20], 2):
        (chance,) = labeller.label([held[a][:20] + held[b][:20]])
        truth = [model.languages.index(a)] * 20 + [model.languages.index(b)] * 20
        right += int((chance.argmax(axis=1) == truth).sum())
        total += 40
        first, size, lang = L.spans_of(chance.argmax(axis=1))
        assert first[0] == 0 and size.sum() == 40 and (lang[1:] != lang[:-1]).all()
    assert total and right >= 0.9 * total
    # Learned transitions: staying is likelier than any change.
    assert (np.diag(model.transition) > 2 * (
        model.transition - np.diag(np.diag(model.transition))).max(axis=1)).all()


def test_language_of_odd_rows(spark, model):
    long = "le chat et la souris " * 60_000
    rows = [(1, None, "fr"), (2, "", "fr"), (3, "12 34 -- ²", None), (4, long, None),
            (None, "le", "x"), (4, long, None), (5, "語" * 3000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    found = [row.asDict() for row in L.identify(table, model).collect()]
    assert [row["lang_pred"] for row in found[:3]] == ["und"] * 3
    assert all(row["score"] == 0 and not row["spans"] for row in found[:3])
    assert found[3]["lang_pred"] == "fr" and found[3] == found[5]
    assert found[3]["n_words"] == 300_000 == sum(s["words"] for s in found[3]["spans"])
    assert found[6]["lang_pred"] in model.languages
    assert L.identify(table.limit(0), model).count() == 0


def test_without_labels_every_language_is_unknown(spark):
    table = spark.createDataFrame([(1, "le chat", None), (2, None, "fr")],
                                  "doc_id long, text string, lang string")
    assert L.fit(table) is None
    assert {row.lang_pred for row in L.identify(table, None).collect()} == {"und"}


# --- conversations -------------------------------------------------------------------------------

def damage(rows: list[tuple]) -> dict:
    """Rows (conv_id, turn, role, text) after damage, by conversation."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
                          .encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = found[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return found


def least_repair(kinds: list[tuple[str, str]]) -> tuple[int, str]:
    """Least (cost, letters), row by row; kinds are (role initial, fault)."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(ways):
        for _ in range(4):
            for state, (cost, letters) in list(ways.items()):
                for to in "ua":
                    if (state, to) in step:
                        way = (cost + 2, letters + "I")
                        ways[to] = min(ways.get(to, way), way)
        return ways

    ways = {"0": (0, "")}
    for role, fault in kinds:
        new = {}
        for state, (cost, letters) in inserted(dict(ways)).items():
            edits = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                rest = fault == "truncated"
                if (state, role) in step:
                    edits.append((step[state, role], cost + rest, "K"))
                edits += [(to, cost + 2 + rest, "R") for to in "ua" if (state, to) in step]
            for to, price, letter in edits:
                way = (price, letters + letter)
                new[to] = min(new.get(to, way), way)
        ways = new
    ways = inserted(dict(ways))
    return min(ways[state] for state in "0a" if state in ways)


def repaired(rows: list[tuple]) -> tuple:
    rows = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1], hashlib.md5(
        row[2].encode()).hexdigest()))
    kinds, seen = [], set()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not said else "duplicate" if (role, text) in seen else
                 "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
        kinds.append((role[:1], fault))
    cost, audit = least_repair(kinds)
    state, lines, at = "0", [], 0
    for letter in audit:
        to = {"0": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        role, text = to, ""
        if letter != "I":
            own, text = rows[at][1:]
            role = own if letter == "K" else to
            at += 1
        if letter != "D":
            lines.append(f"{role}:{text}")
            state = role[:1]
    turns = {turn for turn, *_ in rows if turn is not None}
    initials = [role for role, _ in kinds]
    faults = [fault for _, fault in kinds]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(fault) for fault in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


REPAIRED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            "repaired_sha256")


def by_conversation(rows) -> dict:
    found = {row["conv_id"]: tuple(row[name] for name in REPAIRED) for row in rows}
    assert len(found) == len(rows)
    return found


def test_conversation_repair(spark):
    rows = [tuple(row.values()) for row in pq.read_table(
        f"{FOLDER}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    found = by_conversation(answer(spark, "op13_conversation_repair"))
    assert found == {conv: repaired(kept) for conv, kept in damage(rows).items()}


def odd_turns() -> list[tuple]:
    random = np.random.default_rng(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None], [
        "Yes.", "No", " ", None, "Why?", "\v", "So!\n", "é.", "x" * 3000 + "."]
    rows = [(conv, int(turn) if random.random() > 0.1 else None, roles[random.integers(6)],
             texts[random.integers(9)]) for conv in [*range(30), None]
            for turn in random.permutation(random.integers(1, 25))]
    rows += [(99, turn, "user", "Again and again.") for turn in range(60)]
    rows += [(98, 1, "user", "Same turn."), (98, 1, "user", "Same turn."), (98, 1, "user", "Other.")]
    rows += [(conv, 0, "user", "Hm.") for conv in range(1000, 1100)]  # some lose their only row
    return rows


@pytest.mark.parametrize("limits", [{}, {"max_rows": 4}, {"max_bytes": 2000}])
def test_repair_of_odd_conversations_whole_or_in_chunks(spark, limits):
    rows = odd_turns()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumns({"key": F.lit(1), "part": F.lit("x"), "digest": F.lit(2.0)})
    found = by_conversation(R.repair(R.damaged(table), **limits).collect())
    wanted = {conv: repaired(kept) for conv, kept in damage(rows).items()}
    assert found == wanted
    assert any(row[:7] == (0, 0, 0, 0, 0, 0, "") for row in wanted.values())
    assert R.repair(R.damaged(table.limit(0)), **limits).count() == 0


def test_re_pair_gives_sequences_back():
    random = np.random.default_rng(2)
    sequences = [random.integers(0, 3, n) for n in (0, 1, 5, 40, 300)] + [np.zeros(9, int)] * 3
    rules, written = R.re_pair(sequences)
    first = len(R.TERMINALS)

    def spelt(symbol):
        if symbol < first:
            return [int(symbol)]
        a, b = rules[symbol - first]
        return spelt(a) + spelt(b)

    assert rules and [[x for s in part for x in spelt(s)] for part in written] == [
        s.tolist() for s in sequences]
    assert sum(map(len, written)) < sum(map(len, sequences)) / 2


def test_grammar_gives_the_cost_of_rows_in_turn():
    random = np.random.default_rng(6)
    sequences = [random.integers(0, len(R.TERMINALS), 200) for _ in range(4)]
    rules, written = R.re_pair(sequences)
    matrices = R.Grammar().evaluated(rules)
    for rows, short in zip(sequences, written):
        cost, rope = R.finished(R.repaired_row(short, matrices))
        kinds = [("suax"[(s - 1) % 4], "truncated" if s > 4 else "") if s else ("u", "blank")
                 for s in rows]
        assert (cost, str(rope)) == least_repair(kinds)
