import hashlib

import pytest

from tidegate.llm import pieces

TEXTS = ["", " ", "  two  spaces ", "a\nb\t\tc", "naïve Ünïcode 漢字 \U0001f600 ▁x▁▁ y", "the  the\n\n the", "<s> </s> <unk> <0x0A>", "word" * 3000, "\x00\x01", "z" * 5 + " " * 40 + "end", "é​ x"]


def test_ids_and_text_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    c = pieces.codec(pieces.public_model())
    for t in TEXTS:
        ids, start, end = c.encode(t)
        assert ids == sp.encode(t), t
        assert c.decode(ids) == sp.decode(sp.encode(t))
        data = t.encode()
        assert b"".join(data[s:e] for s, e in zip(start, end)) == data


def test_query_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "the", None), (3, "a\nb", "x"), (3, "a\nb", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.digests(docs, pieces.public_model()).collect()
    assert len(got) == len(rows)
    null = [r for r in got if r.doc_id == 99][0]
    assert (null.n_tokens, null.ids_sha256, null.decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert pieces.digests(docs.limit(0), pieces.public_model()).count() == 0
    full = pieces.encode(docs, pieces.public_model()).collect()
    assert {r.doc_id: len(r.ids) for r in full} == {r.doc_id: r.n_tokens for r in got}


HARD = ["ﬁne ｆｕｌｌ ①② ㎞ Å e\u0301 \u00a0x\u2009y", "  lead", "trail  ", "a\u200bb\ufeffc", "\u3000全角\u3000 ｶﾞ", "½ ™ Ⅳ", "a\r\nb\tc", "\u0130 ǆ ﷺ", "", " ", "x" * 50 + " ½" * 20]


def _model(rule: str, tmp_path, **spec):
    """The public model with the character map of a rule that the library brings along; returns path and normaliser."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = sentencepiece_model_pb2.ModelProto()
    own.ParseFromString(normaliser.serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.public_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.name = rule
    model.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    for k, v in spec.items():
        setattr(model.normalizer_spec, k, v)
    path = str(tmp_path / f"{rule}.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_character_map_and_offsets_equal_the_library(tmp_path, rule, squeeze):
    import random

    import sentencepiece

    path = _model(rule, tmp_path, remove_extra_whitespaces=squeeze)
    c, sp = pieces.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert c.map.units
    rng = random.Random(3)
    letters = "ab  ﬁ½Åe\u0301①ｶﾞ\u3000\u200bЖ漢\U0001f600\t\n"
    for t in TEXTS + HARD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(200)]:
        ids, start, end = c.encode(t)
        want = sp.encode(t, return_type="proto")
        assert ids == [p.id for p in want.pieces], t
        # the library ends a piece where the next one begins; this class where its last character ends. Pieces of one
        # byte are parts of a character, for which the library has a rule of its own
        for i, s, e, p in zip(ids, start, end, want.pieces, strict=True):
            if not c.byte_ids[i]:
                assert s == p.begin and e >= s, (t, p)


def test_parts_of_a_long_text():
    c = pieces.codec()
    text = c.normalize(("word  and   more " * 3000 + "z" * 3000 + " end").encode())[0]
    assert c.segment(text, 64) == c.segment(text, 1 << 30)
    assert c.encode(" " * 200_000 + "x")[0] == c.merger.encode("▁" * 200_001 + "x")


def test_longest_prefix_and_alignment():
    # a trie of two keys built by hand: "a" -> "x", "ab" -> "yz"; units are label | value flag | offset
    class Two(pieces.CharacterMap):
        def __init__(self):
            self.units = (1,)

        def longest(self, data, at):
            return (2, b"yz") if data[at : at + 2] == b"ab" else (1, b"x") if data[at : at + 1] == b"a" else None

    c = pieces.Codec(pieces.public_model())
    c.map = Two()
    text, start, end = c.normalize("aab é".encode())
    assert text == "▁xyz▁é"
    assert list(zip(start, end)) == [(0, 0)] * 3 + [(0, 1), (1, 3), (1, 3)] + [(3, 4)] * 3 + [(4, 5), (5, 6)]
