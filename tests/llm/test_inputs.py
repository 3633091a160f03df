"""Kinds of ids, and lines of white space that isn't ASCII."""

import pytest

from palimpsest.llm import chat, shingle_dedup, substring_dedup, suffix_dedup


@pytest.mark.parametrize("remove", [substring_dedup.remove_repeated_windows, suffix_dedup.remove_repeated_strings, shingle_dedup.drop_similar])
def test_text_ids_are_told(spark, remove):
    with pytest.raises(ValueError, match="whole number"):
        remove(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_a_line_of_other_white_space_is_a_line(spark):
    assert [line for line, _ in chat.line_features("a\n\xa0\nb\n \t\n　")] == ["a", "\xa0", "b", "　"]
    rows = [(1, 0, "user", "a\n\xa0\nb"), (1, 1, "assistant", "c"), (2, 0, "user", "q\n \nr"), (2, 1, "assistant", "　")]
    known = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in known.collect():
        turns = 1 + sum(f[1] == 1 for _, f in chat.line_features(r.transcript)[1:])
        assert turns == len(r.roles) == 2
    model = chat.fit_chat_model(known)
    found = {r.conv_id: r.n_turns for r in chat.format_chats(known, model).collect()}
    assert set(found) == {1, 2}
