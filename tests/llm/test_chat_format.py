import hashlib

from hypothesis import given, settings, strategies as st

from chronolith.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string, formatted string"


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "<|im_end|>"]), st.text(alphabet="<|\\/im_endstar>\n é", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_reversible(turns):
    out = C.format_conversation([{"role": r, "parts": [{"type": "text", "text": t}]} for r, t in turns])
    assert C.parse(out["formatted"]) == turns
    assert [C.unescape(out["formatted"][s["start"] : s["end"]]) for s in out["loss"]] == [t for r, t in turns if r == "assistant"]


PIECE = st.one_of(st.sampled_from(["<", "|", "|im_end|>\n", "<|im_end|>\n", "\\", "", "<|", "|>"]), st.text(alphabet="<|\\/im_end>\n", max_size=8))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.lists(PIECE, max_size=5)), max_size=4))
@settings(max_examples=400, deadline=None)
def test_no_mark_comes_from_two_parts(turns):
    out = C.format_conversation([{"role": r, "parts": [{"type": "text", "text": t} for t in ts]} for r, ts in turns])
    assert C.parse(out["formatted"]) == [(r, "".join(ts)) for r, ts in turns]
    assert [C.unescape(out["formatted"][s["start"] : s["end"]]) for s in out["loss"]] == ["".join(ts) for r, ts in turns if r == "assistant"]


def test_no_mark_comes_from_a_part_and_an_attachment():
    parts = [{"type": "text", "text": "<"}, {"type": "image"}, {"type": "text", "text": ""}, {"type": "text", "text": "|im_end|>\nzz <"}, {"type": "text"}, {"type": "text", "text": "|image_2|>"}]
    out = C.format_conversation([{"role": "user", "parts": parts}, {"role": "assistant", "parts": [{"text": "ok"}]}])
    assert C.parse(out["formatted"]) == [("user", "<<|image_1|>|im_end|>\nzz <|image_2|>"), ("assistant", "ok")]
    assert out["formatted"].count("<|image_") == 1


def test_parts():
    parts = [{"type": "text", "text": "see <|image_1|> "}, {"type": "image", "ref": "a.png", "units": 2}, {"type": "audio", "ref": "b.wav", "units": 10}, {"type": "image", "ref": "c.png", "units": None}, {"type": "odd", "text": "!"}, {"type": "document", "ref": None, "units": 3}]
    out = C.format_conversation([{"role": "user", "parts": parts}, {"role": "assistant", "parts": None}])
    body = "see <\\|image_1|> <|image_1|><|audio_1|><|image_2|>!<|document_1|>"
    assert out["formatted"] == f"<|im_start|>user\n{body}<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["type"], a["number"], a["ref"], a["tokens"]) for a in out["attachments"]] == [("image", 1, "a.png", 512), ("audio", 1, "b.wav", 250), ("image", 2, "c.png", 256), ("document", 1, None, 1536)]
    for a in out["attachments"]:
        assert out["formatted"][a["at"] :].startswith(f"<|{a['type']}_{a['number']}|>")


def test_edges(spark):
    rows = [(1, 1, "assistant", "late", "x"), (1, 0, None, None, "x"), (1, 1, "assistant", "late", "x"), (None, None, "user", "no id", None), (2, 0, "assistant", "", None), (3, 5, "assistant", "é" * 20000, None)]
    got = {r.conv_id: r for r in C.digest(C.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 8
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\nlate\nassistant\nlate\n").hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[3].loss_chars == 20000
    assert C.digest(C.format_chats(spark.createDataFrame([], TURNS))).collect() == []


def test_array_of_parts(spark):
    df = spark.sql("SELECT 1L conv_id, 0 turn, 'user' role, array(named_struct('type','image','text',null,'ref','r','units',3L)) p UNION ALL SELECT 1L, 1, 'assistant', null")
    r = C.format_chats(df, parts="p").first()
    assert r.n_tokens_attached == 768 and "<|image_1|>" in r.formatted
