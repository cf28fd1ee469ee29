from envsense.llm import chat

ROWS = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo\nthere"), (1, 2, None, None), (1, 700, "ann", "x" * 5000), (1, 700, "ann", "x" * 5000), (None, 5, "cy", "é"), (None, None, "ann", ""), (2, 0, "solo", "a")]


def brute(rows):
    found = []
    rows = [(c, t, s or "unknown", x or "") for c, t, s, x in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for who in {r[2] for r in mine}:
            at = 0
            for _, turn, speaker, text in mine:
                head = "<|im_start|>assistant\n" if speaker == who else f"<|im_start|>user name={speaker}\n"
                segment = f"{head}{text}<|im_end|>\n"
                mask = (at + len(head), at + len(segment) - 1) if speaker == who else (at + len(segment),) * 2
                found.append((conv, who, turn, speaker, segment, speaker == who, *mask, at, at + len(segment)))
                at += len(segment)
    return sorted(found, key=str)


def test_against_brute_force(spark):
    turns = spark.createDataFrame([(*r, k) for k, r in enumerate(ROWS)], "conv_id long, turn long, role string, text string, perspective int")
    for block in (1, 2, 512):
        assert sorted(map(tuple, chat.rotate(turns, block=block).collect()), key=str) == brute(ROWS)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_masks_cut_out_the_own_turns(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = sorted((r for r in chat.rotate(turns).collect() if r.conv_id == 1 and r.perspective == "bob"), key=lambda r: r.start)
    whole = "".join(r.segment for r in got)
    assert [whole[r.mask_start : r.mask_end] for r in got if r.trained] == ["yo\nthere<|im_end|>"]
