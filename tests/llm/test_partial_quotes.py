from kinforge.llm import op3_quotes as op3

FIRST = "One is here.\n\nTwo is here\nand goes on\nto its end.\n\nThree is here."


def test_partial_and_interleaved_quotations(spark):
    rows = [
        (1, 0, FIRST), (1, 1, "> One is here.\n>\n> Three is here.\nTwo of three paragraphs."), (1, 2, "> Two is here\n> and goes on\nTwo of three lines."),
        (1, 3, "> One is here.\nMy answer\nhas two lines.\n> Three is here.\nOther."), (1, 4, "> My answer\n> has two lines.\nRight."), (1, 5, "> nowhere said\n>\n> nor this\nNo."),
        (2, 0, "Yes.\nA long way."), (2, 1, "Yes."), (2, 2, "> Yes.\n> A long way.\nThe whole goes before a line."),
    ]
    t = op3.threads(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    out = {(r["conv_id"], r["turn"]): r for r in t}
    assert [out[1, k]["parent_turn"] for k in range(6)] == [None, 0, 0, 0, 3, None]
    assert [out[1, k]["n_links"] for k in range(6)] == [0, 1, 1, 2, 1, 0] and out[1, 3]["n_passages"] == 2
    assert out[2, 2]["parent_turn"] == 0 and out[1, 4]["path"] == [0, 3, 4]
