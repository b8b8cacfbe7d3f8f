"""WARC archives, conversation repair and tokenizer alignment against plain versions."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from optionlake.llm import align, bpe, conversations, queries, warc
from optionlake.llm.common import work_folder

SF = "/root/testdata/sf0.001"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- WARC ----------------------------------------------------------------------


def plain_archive(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), digest, "revisit" if k else "response", ids[0] if k else None, True) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_archives_give_back_every_page(spark):
    dice = random.Random(3)
    rows = [(i, f"http://x/{i}", dice.choice([None, "", "same", "<p>é</p>", f"page {i}"])) for i in range(60)]
    rows += [(5, "http://x/5", "same")] * 3 + [(5, "http://x/5b", "same"), (None, None, "same"), (None, None, "lone"), (None, None, "lone")]
    rows += [(7000, "u\r\nWARC-Type: x", "bad\r\n\r\nurl"), (7001, "漢 字", "x" * 300_000), (7001, None, "x" * 300_000)]
    rows += [(1000 + i, "u", f"{'words ' * 600}{dice.random()}" * 2) for i in range(200)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, copy int, kind string").repartition(3)
    assert got(warc.round_trip(pages)) == plain_archive(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0
    given = spark.read.parquet(f"{SF}/pages.parquet")
    assert got(queries.QUERIES["op11_warc"](spark, SF)) == plain_archive([tuple(r) for r in given.select("page_id", "url", "html").collect()])


def test_copies_are_numbered_in_blocks_and_small_payloads_are_never_revisits(spark):
    pages = spark.range(25_001).select(F.lit(4).alias("page_id"), F.lit("u").alias("url"), F.lit("copied").alias("html"))
    assert warc.planned(pages).groupBy("kind").count().orderBy("kind").collect() == [("response", 1), ("revisit", 25_000)]
    assert warc.planned(pages).select("kind", "copy").distinct().count() == 25_001
    assert warc.planned(pages.limit(9), least=7).where("kind = 'revisit'").count() == 0


def test_archives_start_with_their_dictionary_and_have_a_frame_per_record(spark):
    dice = random.Random(4)
    pages = spark.createDataFrame([(i, f"u{i}", " ".join(dice.choices(["alpha", "beta", "gamma", str(i)], k=3000))) for i in range(80)], "page_id long, url string, html string")
    folder = f"{work_folder(spark)}/warc-test"
    warc.write(pages.coalesce(1), folder)
    path = spark.read.format("binaryFile").load(folder).where("path like '%.warc.zst'").first()
    data, seen = bytes(path.content), 0
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20))
    data = data[8 + size :]
    while data:
        frame = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        text = frame.decompress(data)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        data, seen = frame.unused_data, seen + 1
    assert seen == 80
    back = warc.read(spark, folder, payloads=True)
    assert {(r.page_id, bytes(r.payload).decode()) for r in back.collect()} == {(r.page_id, r.html) for r in pages.collect()}
    assert not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("path like '%_drafts%'").count()


def archive_of(*records, words=None, extra=b""):
    press = zstandard.ZstdCompressor(level=3, dict_data=words)
    return io.BytesIO((warc.leading_frame(words) if words else b"") + extra.join(press.compress(r) for r in records))


def one(payload=b"hello", **changes):
    given = {"page_id": 1, "url": "u", "payload": payload, "sha": hashlib.sha1(payload).digest(), "size": len(payload), "kind": "response", "refers_to": None, "copy": 0, "date": "2020-01-01T00:00:00Z"}
    return warc.record(**{**given, **changes})


def test_reader_says_what_is_wrong_with_a_record():
    fine = one()
    assert [r.problem for r in warc.records(archive_of(fine, fine, extra=b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"))] == [None, None]
    wrong = {
        fine.replace(b"Content-Length: 5", b"Content-Length: 6"): "HTTP Content-Length 6, but the payload has 5 bytes",
        fine.replace(b"hello", b"hallo"): "the payload does not have its digest",
        fine[:-1]: "Content-Length", fine + b"x": "Content-Length", b"nothing": "no WARC header",
        fine.replace(b"WARC-Date", b"WARC-Data"): "no warc-date", fine.replace(b"WARC-Type: response", b"WARC-Type response"): "malformed header line",
        one(kind="revisit"): "a revisit needs a digest, a length and no payload",
    }
    for data, problem in wrong.items():
        (record,) = warc.records(archive_of(data))
        assert record.problem.startswith(problem)
    whole = archive_of(fine).getvalue()
    assert [r.problem for r in warc.records(io.BytesIO(whole[:-3]))] == ["a frame is cut short"]
    assert [r.problem for r in warc.records(io.BytesIO(b"text"))] == ["not a Zstandard frame"]
    assert [*warc.records(io.BytesIO(b""))] == []
    revisit = one(b"", kind="revisit", size=77, refers_to=9)
    (record,) = warc.records(archive_of(revisit))
    assert (record.problem, record.size, record.fields["refers-to-page-id"]) == (None, 77, "9")


# --- conversations -------------------------------------------------------------


def plain_repair(rows):
    """{conv_id: row of the result}, states walked from the last row to the first, audits as text."""
    out, following, name = {}, {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            last = (re.findall(r"[^\x20\x09-\x0D]", text) or [""])[-1]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in mine if r[0] is not None}
        best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
        for (_, role, _), fault in reversed([*zip(mine, faults, strict=True)]):
            cut, own = 3 * (fault == "truncated"), {}
            for state in range(4):
                ways, to = [(4 + best[state][0], "D" + best[state][1])], following[state]
                if fault not in ("blank", "duplicate"):
                    if role[:1] == "s" and state == 0:
                        ways.append((cut + best[1][0], "K" + best[1][1]))
                    if role[:1] == name[to][0]:
                        ways.append((cut + best[to][0], "K" + best[to][1]))
                    ways.append((3 + cut + best[to][0], "R" + best[to][1]))
                own[state] = min(ways)
            for _ in range(4):
                own = {s: min(own[s], (3 + own[following[s]][0], "I" + own[following[s]][1])) for s in range(4)}
            best = own
        lines, state, left = [], 0, iter(mine)
        for edit in best[0][1]:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit != "D":
                state = 1 if edit == "K" and role[:1] == "s" else following[state]
                lines.append(f"{role if edit == 'K' else name[state]}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal,
            *best[0], hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.fixture(scope="module")
def chats():
    dice, rows = random.Random(5), []
    texts = [None, "", " \n", "Hello.", "ok", "so what? ", "Yes!", "cut ", "é…"]
    for conv in [None, *range(60)]:
        for turn in range(dice.choice([0, 1, 2, 5, 9, 30])):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            rows.append((conv, dice.choice([None, turn, turn, turn, turn // 2, turn * 3]), role, dice.choice([*texts, *(f"text {dice.random()}." for _ in range(8))])))
    rows += [(7, 3, "user", "again.")] * 9
    return rows + [(1000, t, dice.choice(["user", "assistant", "system"]), dice.choice([f"x{t}.", f"x{t}", "go!"])) for t in range(400)]


@pytest.mark.parametrize("shard", [100_000, 13])
def test_repair_is_the_cheapest_and_least(spark, chats, shard, monkeypatch):
    monkeypatch.setattr(conversations, "SHARD", shard)
    table = spark.createDataFrame([(*r, 1, "x") for r in chats], "conv_id long, turn long, role string, text string, copies int, fault string")
    assert got(conversations.repair(table)) == sorted(plain_repair(chats).values(), key=repr)
    assert conversations.repair(table.limit(0)).count() == 0


def test_repair_of_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_conversation_repair"](spark, SF)) == sorted(plain_repair(rows).values(), key=repr)


def test_grammar_shares_rules_between_sequences():
    dice = np.random.default_rng(1)
    lengths = dice.integers(1, 40, 500)
    codes = dice.integers(0, 9, lengths.sum()).astype(np.uint8)
    codes[:4000] = np.tile([3, 5, 3, 5, 0, 3, 5, 4], 500)
    grammar = conversations.Grammar(codes, lengths)
    assert len(grammar.roots) == 500
    uses = Counter(s for rule in grammar.rules.tolist() for s in rule) + Counter(grammar.roots.tolist())
    assert max(uses[s] for s in range(conversations.LETTERS, len(grammar.cost))) >= 30  # one matrix, many users
    at = np.cumsum(lengths) - lengths
    for k in range(0, 500, 7):
        best = [(0, ""), *[(conversations.FAR, "")] * 3]
        for symbol in codes[at[k] : at[k] + lengths[k]].tolist():
            step = conversations._step(symbol)
            best = [min((best[i][0] + step[i][j][0], best[i][1] + step[i][j][1]) for i in range(4)) for j in range(4)]
        for j in range(4):
            if best[j][0] < conversations.FAR:
                assert (int(grammar.cost[grammar.roots[k], 0, j]), grammar.audit(int(grammar.roots[k]), 0, j)) == best[j]


# --- alignment -----------------------------------------------------------------


def test_diagonal_finds_every_common_end():
    dice = random.Random(6)
    for _ in range(3000):
        ends = sorted(dice.sample(range(1, 300), dice.randint(1, 60)))
        a, b = (sorted({e for e in ends if dice.random() < 0.8} | {300}) for _ in range(2))
        last_a, last_b = align.cuts(align.diagonal(a, b))
        assert [a[i] for i in last_a] == [b[j] for j in last_b] == sorted({*a} & {*b})
    assert align.diagonal([], []) == []
    assert len(align.diagonal([*range(1, 5000)], [*range(1, 5000)])) < 15  # doubling, not one by one


def plain_alignment(rows, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path_a)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = bpe.byte_letters()
    known = {i: bytes(letters[c] for c in t) for t, i in tok.get_vocab().items() if all(c in letters for c in t)}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        side_a, side_b = [known[i] for i in a], [piece(i) for i in b]
        if not text or not b"".join(side_a) == (" " + text).encode() == b"".join(side_b):
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([*map(len, side_a)]).tolist(), np.cumsum([*map(len, side_b)]).tolist()
        at_b = {e: j for j, e in enumerate(ends_b)}
        meet = [(i, at_b[e]) for i, e in enumerate(ends_a) if e in at_b]
        links = [(a[i], b[j]) for i, j in meet]
        counts.update(links)
        groups, i, j = [], 0, 0
        for x, y in meet:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        docs.append((doc_id, a, b, links, groups))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        [
            (d, len(a), len(b), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, a, b, k, g in docs
        ],
        key=repr,
    )


def test_alignment_equals_a_plain_one(spark, monkeypatch):
    paths = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model")
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [
        (1, None), (1, ""), (None, "<|endoftext|> and <s> are plain </s>"), (2, "a ▁ b"), (3, "  two  spaces \n\t x \x1c y z "), (4, "漢字 🙂 ß é \x00 \x07"),
        (5, "x" * 20_000), (6, "so it goes " * 3_000), (6, "so it goes " * 3_000), (7, " "), (8, "\n"), (9, "<0x41> ﬁ ǅ é"), (10, "don't we'll"),
    ]
    rows = given + odd
    table = spark.createDataFrame([(*r, 3, "n") for r in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    want = plain_alignment(rows, *paths)
    assert got(align.compare(table, *paths)) == want
    monkeypatch.setattr(align, "BATCH", 500)
    assert got(align.compare(table, *paths)) == want
    assert align.compare(table.limit(0), *paths).count() == 0
