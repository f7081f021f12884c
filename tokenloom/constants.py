"""Values that results depend on, stated in one place."""

# They must equal the published method's for results to match.
IGNORE_INDEX = -100
PAD_TOKEN = "[PAD]"
EOS_TOKEN = "</s>"
BOS_TOKEN = "<s>"
UNK_TOKEN = "<unk>"

WORD_MARKERS = {
    "llama": "▁",
    "gpt_neox": "Ġ",
    "gpt2": "Ġ",
    "qwen2": "Ġ",
    "bert": "##",
}
DEFAULT_STUDENT_MARKER = "Ġ"
DEFAULT_TEACHER_MARKER = "_"

SPECIAL_PAIRS = {"</s>": "<|im_end|>", "<|endoftext|>": "<|endoftext|>"}
SPECIAL_PAIRS_SORTED = {"</s>": "<|im_end|>", "<unk>": "<|endoftext|>"}

INPUT_HEADER = "\n### Input:\n"
OUTPUT_HEADER = "\n### Output:\n"

ENTROPY_EPSILON = 1e-10
MASKED_LOGIT = -10000.0
MASKED_LOGIT_SORTED = -100.0
DEFAULT_BLOCK_SIZE = 1024
DEFAULT_TOPK = 100
DEFAULT_THRESHOLD = 0.3
MATCHING_OFF_BELOW = 0.0001
DEFAULT_ALPHA = 0.9
DEFAULT_TEMPERATURE = 0.8
DEFAULT_VALIDATION_PERCENT = 5
DEFAULT_SEED = 42
DEFAULT_LOG_EVERY = 3
RESET_EVERY = 100
PAD_MULTIPLE = 8
MLM_PROBABILITY = 0.15

# Ours: an unmapped id is NULL inside tables and 0 only in the JSON file.
UNK_ID = 0
