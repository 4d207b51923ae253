"""Explicit schemas of the files this library reads; nothing is inferred.

`target` holds one string or a list of strings, so it is read as a variant, which keeps the two apart, and
then normalized with `functions.answers.target_array`. `infer_steps` holds "gt" or a number; see
`operators.rollouts.with_ground_truth` for the split form.
"""

RAW_ANSWER = "question string, answer string"
STEPWISE = "question string, steps array<string>, answer string"
QUERY_RESPONSE = "query string, response string"
CANONICAL = "input string, output string, answer string, solutions array<string>"
MINIMAL = "input string, output string"
ROLLOUT_METADATA = (
    "example_id long, rollout_id int, step_id int, input string, target variant, timestep double, "
    "label double, final_text string, shard string, row int"
)
ROLLOUT_LOG = (
    "input string, solution string, infer_steps string, text string, reward double, lst_reward double, "
    "tokens array<array<array<float>>>"
)
LATENT_SHARD = "shard string, row int, latent array<float>"
