"""Every user turn of a long conversation has its prompt."""

from tunelake.plans import QUERIES
from tunelake.plans.conversations import by_forties, joined_conversations


def test_every_user_turn_has_a_prompt(spark, sf_dir):
    users = joined_conversations(spark, sf_dir, by_forties()).where("role = 'user'").select("conv_id", "turn")
    prompts = QUERIES["render_every_long_prompt"].run(spark, sf_dir)
    expected = {tuple(r) for r in users.collect()}
    found = [(r["conv_id"], r["turn"]) for r in prompts.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert max(turn for _, turn in found) > 128
