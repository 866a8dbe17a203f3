"""Conversation trie, hard negatives and token files against brute force, with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oracle import compare, connect
from venuekit.llm import hard_negatives as H, prefix_trie as P, token_files as T
from venuekit.llm.queries import TRIE_COLUMNS, TRIE_SQL

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- conversation trie ---------------------------------------------------------------------


def expected_trie(rows, key=P.turn_key):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((t is not None, t or 0, digest, role, text))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = {k: [x[3:] for x in sorted(v)] for k, v in own.items() if k in (c, int(np.fix(c / 100)) * 100)}
        paths[c] = tuple(turns.get(int(np.fix(c / 100)) * 100, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    saved, leaves, kids = collections.Counter(), collections.Counter(), collections.Counter()
    for path, found in members.items():
        childless = all(len(paths[c]) == len(path) for c in found)
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(found) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += childless
        if path:
            kids[path[:-1]] += 1
    return sorted(
        (min(found), len(path), min(members[path[:-1]]) if path else -1, len(found), kids[path], leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in sorted(found) if len(paths[c]) == len(path)).encode()).hexdigest())
        for path, found in members.items()
    )


def trie_rows(seed=4):
    rng = random.Random(seed)
    pool = [("user", f"text {i} é" * (i + 1)) for i in range(4)] + [(None, None), ("a", "b"), ("ab", "")]
    rows = [(c, t, *rng.choice(pool)) for c in range(-3, 260) if c % 7 for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", "the same") for c in range(300, 500) for t in range(3)]  # a group of copies
    rows += [(500, 1, "x", "tie"), (500, 1, "x", "tie"), (500, 1, "w", "tie"), (500, None, "n", "first"), (None, 1, "u", "none")]
    rows += [(601, t, "u", str(t)) for t in range(1)] + [(700 + c, t, "u", str(t % 3)) for c in range(4) for t in range(40 + c)]
    return rows


@pytest.mark.parametrize("segment,block", [(256, 4 << 20), (8, 300)])
def test_trie_by_brute_force(spark, segment, block):
    rows = trie_rows()
    schema = "conv_id long, turn long, role string, text string, depth string, key string, start string"
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(5)
    got = P.conversation_trie(frame, segment, block).select(TRIE_COLUMNS).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == expected_trie(rows)
    assert [r.depth for r in got if r.parent_conv_id is None] == [0]
    assert P.conversation_trie(frame.limit(0)).count() == 0


def test_trie_of_a_sliced_group(spark):
    rows = [(c, t, "u", "same") for c in range(1000, 1400) for t in range(2)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many slices as partitions
    try:
        got = P.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(TRIE_COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == expected_trie(rows)


def test_trie_of_turnless_conversations(spark):
    rows = [(c, 0, "u", "t") for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6][:5]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = P.conversation_trie(frame).select(TRIE_COLUMNS).collect()
    assert [tuple(r)[:2] + tuple(r)[3:7] for r in got] == [(min(r[0] for r in rows), 0, 5, 0, 1, 0)]


def test_trie_sql_on_odd_rows(spark):
    con = connect("/root/testdata/sf0.001")
    rows = trie_rows(9)
    con.execute("CREATE TABLE convs (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO convs VALUES (?, ?, ?, ?)", rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert compare(P.conversation_trie(frame).select(TRIE_COLUMNS), con, f"WITH {TRIE_SQL} SELECT {', '.join(TRIE_COLUMNS)} FROM trie") is None


@pytest.mark.parametrize("n", [3, 15, 40, 300])
def test_radix_nodes_grow_and_find(n):
    rng = random.Random(n)
    keys = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 5]))) for _ in range(n)]
    keys += [bytes([i]) + b"tail" for i in range(min(n, 256))] + [k[:1] for k in keys] + [b""]
    tree = P.RadixTree()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    found, rooms, stack = collections.defaultdict(list), set(), [(tree.root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.prefix
        rooms.add(node.room)
        assert node.end == len(path) and len(node.children()) <= node.room
        found[path] += node.rows
        stack += [(node.child(b), path + bytes([b])) for b in range(256) if node.child(b) is not None]
    want = collections.defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    assert {k: sorted(v) for k, v in found.items() if v} == want
    assert max(rooms) >= {3: 4, 15: 16, 40: 48, 300: 256}[n]


def test_shared_turns():
    a, b = bytes(range(48)), bytes(range(40)) + bytes(8)
    assert (P.shared_turns(a, b), P.shared_turns(a, a), P.shared_turns(a, a[:16]), P.shared_turns(a, b"")) == (2, 3, 1, 0)


# --- hard negatives ------------------------------------------------------------------------


def vector_rows(seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(scale=0.2, size=6)], int(rng.integers(3))) for i in range(700)]
    same = [0.3, 0.2, -0.1, 0.0, 0.25, 0.1]
    rows += [(1000 + i, list(same), i % 4) for i in range(500)]  # one very common vector
    centre = rng.normal(size=(8, 6))
    rows += [(2000 + i, [float(x) for x in centre[i % 8] + rng.normal(scale=0.02, size=6)], int(rng.integers(4))) for i in range(600)]
    rows += [(3000, None, 1), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3002, [float("nan")] * 6, 1), (3003, [float("inf")] + [0.0] * 5, 1)]
    rows += [(3100, [0.1] * 6, None), (None, [0.1] * 6, 1), (3200, [0.5, 0.5], 2), (3300, [], 0), (3400, [0.0] * 6, 1), (3500, [-5.0] * 6, 9)]
    rows += [(3600, [0.4] * 6, 2), (3600, [0.4] * 6, 2), (3600, [0.2] * 6, 1)]  # a repeated row, a repeated id
    return rows


def expected_negatives(rows):
    usable = [(i, [np.floor(256 * x) for x in v] + [0.0] * (6 - len(v)), (l + 1) % 10 if i % 7 == 0 else l)
              for i, v, l in rows if i is not None and v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, l in usable:
        if i % 100:
            continue
        scored = sorted((-int(np.dot(v, w)), j, m) for j, w, m in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == l][:5]:
            fit = [x for x in scored if x[2] != l and -30 * s <= -100 * x[0] <= -90 * s][:10]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return out


def mined(spark, rows, block, leaf):
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, aux string, far double").repartition(3)
    vectors = H.clean_vectors(frame)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(256 * x).cast("double"))
    return H.mine(vectors.withColumns({"label": moved, "v": whole}), F.col("id") % 100 == 0, block=block, leaf=leaf)


@pytest.mark.parametrize("block,leaf", [(2048, 256), (64, 8)])
def test_negatives_by_brute_force(spark, block, leaf):
    rows = vector_rows()
    assert sorted(tuple(r) for r in mined(spark, rows, block, leaf).collect()) == sorted(expected_negatives(rows))


def test_no_vectors_no_negatives(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.mine(H.clean_vectors(frame), F.col("id") % 100 == 0).count() == 0
    with pytest.raises(ValueError, match="too large"):
        H.mine(spark.createDataFrame([(1, 0, [1e9])], "id long, label long, v array<double>"), F.lit(True))


def test_cover_tree_radii_hold_and_skip():
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, size=(12, 16))
    points = (centres[rng.integers(12, size=2000)] + rng.integers(-4, 5, size=(2000, 16))).astype(float)
    longest = (points**2).sum(1).max()
    aux = np.sqrt(longest - (points**2).sum(1))
    tree = H.CoverTree.unpack(H.CoverTree.build(points, aux, np.arange(2000), np.zeros(2000, int)).pack())
    assert sorted(tree.ids) == list(range(2000)) and (tree.points == points[tree.ids]).all()
    whole = np.column_stack([points, aux])

    def below(node):
        start, end = tree.bags[node]
        return list(tree.ids[start:end]) + [i for kid in range(*tree.kids[node]) for i in below(kid)]

    spot = {tuple(p): w for p, w in zip(points, whole)}
    for node in range(len(tree.radius)):
        c = spot[tuple(tree.centre[node])]
        assert (np.sqrt(((whole[below(node)] - c) ** 2).sum(1)) <= tree.radius[node]).all()
        kids = [spot[tuple(tree.centre[k])] for k in range(*tree.kids[node])]
        for i, a in enumerate(kids):
            assert all(np.linalg.norm(a - b) > tree.radius[node] / H.BASE - 1e-4 for b in kids[:i])
    q = points[:5]
    slots = H.Slots(q, np.arange(5), np.zeros(5, int), np.arange(5), np.full(5, -np.inf), np.full(5, np.inf), 3, True)
    assert H.search(tree, slots) < 1000
    for i in range(5):
        want = sorted((-(q[i] @ points[j]), j) for j in range(2000) if j != i)[:3]
        assert [(-s, j) for s, j in zip(slots.score[slots.slot == i], slots.id[slots.slot == i])] == want


# --- token files ---------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "\n\t ", "Hello WÖRLD, don't!", "a.,;b 12½². İ. Σας. x́. क़. ;", "<|endoftext|> <|ENDOFTEXT|>", "x" * 5000, "end<|startoftext|>.",
    " ".join(f"w{i % 700}x," for i in range(60_000)), "日本語のテキスト。 é́ ﬁ    z\r\nq", "NASA'S isn't I'LL",
]


def token_rows():
    rows = [(40 + 3 * i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (5, "tie one"), (5, "tie two"), (7, "again"), (7, "again")]
    return rows + [(1000 + i, f"document {i} says {'word ' * (i % 9)}.") for i in range(200)]


def test_token_files_round_trip(spark, tmp_path):
    rows = token_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, n long").repartition(3)
    folder = str(tmp_path / "tokens")
    got = T.token_table(docs, folder, TOKENIZER, shard_bytes=2_000).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    found = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert collections.Counter(found) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.n_tokens for r in got] == [len(t) for _, t in found]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    some = T.read_documents(spark, folder, [5, 67, 1003, 9999]).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in some) == sorted((r.doc_id, r.start, r.ids) for r in got if r.doc_id in (5, 67, 1003))
    assert spark.read.parquet(f"{folder}/manifest").count() > 3


def test_token_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_table(docs, str(tmp_path / "none"), TOKENIZER).count() == 0


def test_one_dictionary_shortens_frames():
    ids = [np.array([i % 50 for i in range(s, s + 60)], "<u2").tobytes() for s in range(400)]
    data = T.train_dictionary(ids, 4096)
    with_it, plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data)), zstandard.ZstdCompressor()
    assert sum(len(with_it.compress(b)) for b in ids) < sum(len(plain.compress(b)) for b in ids)
    assert T.train_dictionary([b"ab"]) == b"ab" and T.train_dictionary([]) == b""


def test_index_finds_damage():
    data = T.pack_index(bytes(32), 2, [None, 7], [0, 3, 9], [0, 1, 4])
    index = T.ShardIndex(data)
    assert index.docs == [None, 7] and index.ends.tolist() == [0, 3, 9] and index.counts.tolist() == [0, 1, 4]
    with pytest.raises(ValueError):
        T.ShardIndex(data[:50] + b"x" + data[51:])
