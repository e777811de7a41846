from texts import prose

from tessera.llm.line_dedup import without_repeated_lines


def line(rng, n):
    return prose(rng, n).capitalize() + "."


def left(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in without_repeated_lines(rows).orderBy("doc_id").collect()]


def share_removed(spark, rng, passages, around):
    """Of each passage's words: the share that goes from a second text."""
    texts = [f"{around(rng)}{p}{around(rng, False)}" for p in passages for _ in range(2)]
    got = left(spark, texts)
    assert got[0] == texts[0]
    return [(len(texts[2 * i + 1].split()) - len(got[2 * i + 1].split())) / len(p.split()) for i, p in enumerate(passages)]


def test_passages_of_short_lines_go_whole(spark, rng):
    shapes = [(6, 9), (5, 11), (7, 8), (9, 6)]
    passages = ["\n".join(line(rng, words) for _ in range(lines)) for lines, words in shapes for _ in range(10)]
    around = lambda rng, before=True: "".join(f"{line(rng, 7)}\n" if before else f"\n{line(rng, 7)}" for _ in range(4))
    assert min(share_removed(spark, rng, passages, around)) == 1


def test_blank_lines_do_not_break_a_passage(spark, rng):
    passages = ["\n\n".join(line(rng, rng.choice(sizes)) for _ in range(10)) for sizes in ([12, 15, 19], [3, 6, 9]) for _ in range(3)]
    around = lambda rng, before=True: f"{line(rng, 30)}\n\n" if before else f"\n\n{line(rng, 30)}"
    assert min(share_removed(spark, rng, passages, around)) == 1


def test_passages_inside_lines_without_sentence_ends(spark, rng):
    passages = [prose(rng, n) for n in (60, 80, 120, 200, 300) for _ in range(8)]
    around = lambda rng, before=True: f"{prose(rng, 40)} " if before else f" {prose(rng, 40)}"
    shares = share_removed(spark, rng, passages, around)
    assert sum(x > 0 for x in shares) >= 0.9 * len(shares) and min(shares[-16:]) > 0.8
    stops = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(20)) + "。" for _ in range(16)]
    one, two = "".join(stops[:12]), "".join(stops[12:] + stops[:12])
    assert left(spark, [one, two])[1] == "".join(stops[12:])
