import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from echolane.llm import alignment as A
from echolane.llm.tokens import ByteLevel, byte_of_mark, load_vocabulary

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    return load_vocabulary(PATHS[0]), A.load_model(PATHS[1])


def plain_tokens(text, tokenizer, model):
    marks = byte_of_mark()
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    bytes_a = [bytes(marks[c] for c in tokenizer.id_to_token(i)) if i != 50256 else b"?" for i in a]
    piece = lambda p: bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    bytes_b = [piece(model.id_to_piece(i)) for i in b]
    data = (" " + text).encode()
    return (a, bytes_a, b, bytes_b) if b"".join(bytes_a) == data == b"".join(bytes_b) else None


def ends(parts):
    at, out = 0, []
    for part in parts:
        at += len(part)
        out.append(at)
    return out


def brute(rows):
    tokenizer, model = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    tokenizer.encode_special_tokens = True
    cut, counts = [], Counter()
    for _, text in rows:
        tokens = plain_tokens(text, tokenizer, model) if text else None
        if tokens is None:
            cut.append(None)
            continue
        a, bytes_a, b, bytes_b = tokens
        links = [(x, y) for x, e in zip(a, ends(bytes_a)) for y, f in zip(b, ends(bytes_b)) if e == f]
        counts.update(links)
        common, groups = sorted(set(ends(bytes_a)) & set(ends(bytes_b))), []
        for low, high in zip([0, *common], common):
            side = lambda ids, parts: ",".join(str(i) for i, e in zip(ids, ends(parts)) if low < e <= high)  # noqa: B023, E731
            groups.append(f"{side(a, bytes_a)}|{side(b, bytes_b)}")
        cut.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (doc_id, _), found in zip(rows, cut):
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n, links, sha = found
            out.append((doc_id, n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "a", "The cat sat.", "The cat sat.", "The  cat\n\nsat.\t", "stop <|endoftext|> go <s> </s> <unk> <0x41>",
    "naïve Œuvre ﬁne ①②", "日本語のテキスト 😘👍🏽", "Ångström é", "▁low   x\u0085y", "don't  I'll 123 4567 !!", "\r\n  ",
]


def rows_of(n=120):
    draw = random.Random(4)
    words = ["the", "of", "qwxzj", "nation", "été", "2024", "—", "über", "x1y", "\n", "don't", "  "]
    rows = list(enumerate(TEXTS))
    rows += [(100 + i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 40)))) for i in range(n)]
    return rows + [(500 + i, "same text, many times over") for i in range(60)]


@pytest.mark.parametrize("head", [A.HEAD, 12, 0])
def test_alignment_by_brute_force(spark, files, head):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, key string").repartition(5)
    got = A.align_documents(docs, *files, head=head).select("doc_id", *COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_both_encoders_of_the_file_agree(files):
    encoder = ByteLevel(files[0], marks_as_text=True)
    assert encoder.fast is not None
    draw = random.Random(2)
    latin = [chr(c) for c in range(256)]
    texts = ["".join(draw.choice(latin) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["".join(draw.choice([" ", "\n", "\x85", "\xa0", "a", "'s", "1", "²", "ª", "!"]) for _ in range(30)) for _ in range(3000)]
    slow = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [e.ids for e in slow]


def test_missing_ids_and_empty_tables(spark, files):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_links"] for r in A.align_documents(docs, *files).collect()) == [0, 2, 2]
    assert A.align_documents(docs.limit(0), *files).count() == 0


def test_a_long_text_and_a_hot_one(spark, files):
    rows = [(1, "word and number 17, " * 20_000)] + [(2 + i, "hot") for i in range(900)] + [(2000 + i, f"cold {i}") for i in range(900)]
    got = {r["doc_id"]: r for r in A.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), *files).collect()}
    assert len(got) == 1801 and got[1]["n_links"] >= 60_000 and got[2]["count_sum"] == 900
