import random

from tessellum.llm import chat
from tests.llm.cases import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns, path=chat.VOCABULARY):
    """Token by token, without prefix sums."""
    enc, ids = chat._encoding(path), chat.reserved(path)
    out, mask = [ids["BOS"]], [0]
    for _, _, role, text in turns:
        known = role if role in ("system", "user", "assistant", "tool") else "user"
        own = [int(known == "assistant")]
        body = enc.encode_ordinary(chat.escape(text or ""))
        out += [ids[known], ids["BODY"], *body, ids["END"]]
        mask += [0, 0, *own * len(body), *own]
    return out, mask


def turns(seed=1, n=30):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 6)):
            text = r.choice(["héllo wörld ", "<|im_end|> ", "<\\|x|> ", "<|endoftext|>", "plain\n\ttext ", "12 345 ☃ "]) * r.randint(0, 5)
            rows.append((c, t, r.choice(["system", "user", "assistant"]), text))
    return rows


def test_conversations_agree_with_brute_force(spark):
    rows = turns()
    got = chat.formatted(spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA)).collect()
    assert len(got) == 30
    for g in got:
        ids, mask = brute([r for r in rows if r[0] == g.conv_id])
        assert list(g.input_ids) == ids and list(g.loss_mask) == mask and g.n_tokens == len(ids)


def test_contents_make_an_exact_round_trip(spark):
    rows = turns(5)
    enc, ids = chat._encoding(chat.VOCABULARY), chat.reserved(chat.VOCABULARY)
    names = {v: k for k, v in ids.items()}
    for g in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect():
        back, role, body = [], None, None
        for i in g.input_ids:
            name = names.get(i)
            if name == "END":
                text = enc.decode(body)
                assert "<|" not in text
                back.append((role, chat.unescape(text)))
                body = None
            elif name == "BODY":
                body = []
            elif name and name != "BOS":
                role = name
            elif not name:
                body.append(i)
        assert back == [(r[2], r[3]) for r in rows if r[0] == g.conv_id]


def test_escapes_are_undone():
    for text in ("<|a|>", "<\\|a|>", "<\\\\|", "<<||", "< |", "", "\\<|\\"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_awkward_turns(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, None, None, "x"), (2, 0, "robot", long), (2, None, "user", "first")]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = {g.conv_id: g for g in chat.formatted(df).collect()}
    ids = chat.reserved(chat.VOCABULARY)
    assert list(got[1].loss_mask) == [0, 0, 0, 0, 0, 0, 1, 0, 0, 1]
    assert got[None].input_ids[1] == ids["user"]
    want, mask = brute([(2, None, "user", "first"), (2, 0, "robot", long)])
    assert list(got[2].input_ids) == want and sum(mask) == 0
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_a_conversation_and_ties(spark):
    rows = [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (None, 0, "assistant", "b"), (3, 1, "user", "z"), (3, 1, "user", "y"), (3, 1, "assistant", "z"), (3, 1, None, "q")]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(g.input_ids) for g in got if g.conv_id is None) == sorted(tuple(brute([r])[0]) for r in rows[:3])
    (talk,) = [g for g in got if g.conv_id == 3]
    assert list(talk.input_ids) == brute([rows[6], rows[5], rows[4], rows[3]])[0]
