import hashlib
import random

from pyspark.sql import functions as F

from panelscope.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<<SYS>>\n x \n<</SYS>>\n", "\\l \\\\ \\b[INST]", "<s></s>", "<<<SYS>>", " lead", "trail ", "", "<<ROLE 61>>\nq\n<</ROLE>>\n", "漢 \\", "[INST] [INST]", "[/INST", "a</s"]


def test_round_trip():
    rng = random.Random(0)
    parts = ["<", ">", "/", "s", "</s>", "[INST]", "[/INST]", "[", "]", "\\", "\\l", "<<SYS>>", "<</SYS>>", "\n", " ", "é", "<<ROLE ", "x"]
    for k in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a>b\n"]), rng.choice(ODD) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(6))]
        text, spans = chat.write(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        for _, t in turns:
            assert not any(c in chat.escape(t) for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE", "<</ROLE"))


def brute_paths(m, best):
    parent = {n: (p if any(p == x[0] for x in m) else None) for n, p, _ in m}
    score = {n: s or 0.0 for n, _, s in m}
    out = {}
    for leaf in set(parent) - set(parent.values()):
        path = [leaf]
        while (p := parent[path[-1]]) is not None:
            path.append(p)
        out.setdefault(path[-1], []).append((-sum(score[x] for x in path) / len(path), leaf, path[::-1]))
    return {(r, k + 1, leaf): path for r, ls in out.items() for k, (_, leaf, path) in enumerate(sorted(ls)[:best])}


def test_paths_equal_brute_force(spark):
    rng = random.Random(7)
    m = [(0, None, 1.0), (1, 99, None)]
    m += [(i, rng.randrange(max(0, i - 8), i), float(rng.randrange(5))) for i in range(2, 80)]
    m += [(200 + i, 199 + i if i else None, 1.0) for i in range(130)]  # one long thread
    m += [(400, 401, 1.0), (401, 400, 1.0), (402, 401, 9.0)]  # a cycle and what hangs on it
    got = {}
    for r in chat.paths(spark.createDataFrame(m, "node long, parent long, score double"), best=2).orderBy("depth").collect():
        got.setdefault((r.root, r["rank"], r.leaf), []).append(r.node)
    assert got == brute_paths([x for x in m if x[0] < 400], 2)


def test_query(spark, sf):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(ODD)) for c in range(20) for t in range(rng.randrange(1, 7))]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(300)]
    rows += [(60, 5, None, None), (60, None, "assistant", "first"), (60, 5, None, None), (None, 0, "assistant", "x"), (61, 3, "tool", "y"), (61, 1, "user", "z")]
    d = sf(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash")))
    got = {r.conv_id: r for r in chat.op4_chat(spark, d).collect()}
    convs = {}
    for c, t, r, x in [*rows, (-1, 0, "user", ODD[0]), (-1, 1, "assistant", ODD[0])]:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss)), c
        assert got[c].formatted_chars >= sum(len(x) for _, _, x in ts)


def test_empty(spark, sf):
    d = sf(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert [r.conv_id for r in chat.op4_chat(spark, d).collect()] == [-1]
