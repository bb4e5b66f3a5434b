"""Values that decide results and therefore may not vary between implementations."""

# Curation thresholds and defaults.
USABLE_SCORE = 7.0
UPLOAD_SCORE = 10.0
LISTING_SCORE = 0.0
THUMB_UP_SCORE = 10
THUMB_DOWN_SCORE = 2
UPLOAD_SOURCE = "manual_upload"
RATING_SOURCE = "human_feedback"
SOURCE_LABELS = {"human_feedback": "Chat rating", "manual_upload": "Added manually"}
UNKNOWN_SOURCE = "Unknown source"

# White space stripped from both ends of a line or prompt.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Conversation texts.
DEFAULT_SYSTEM_PROMPT = "You are a helpful AI assistant."
THINKING_SUFFIX = (
    "\n\nYou MUST begin by reasoning step-by-step inside <think>...</think> tags. Do NOT speak to the user "
    "inside the tags. usage: <think>internal thought</think> final response"
)
DIRECT_SUFFIX = "\n\nAnswer directly without showing your thinking process."
ONE_SHOT_USER = "Hello"
ONE_SHOT_ASSISTANT = (
    "<think>The user is greeting me. I should respond in character.</think>Greetings. I am ready to assist."
)
PERSONAS = {
    "Assistant": "You are a helpful AI assistant.",
    "Coder": "You are a senior software engineer. Give correct, concise answers with short code examples.",
    "Tutor": "You are a patient tutor. Explain step by step in plain language and check understanding.",
    "Pirate": "You are a cheerful pirate. Answer every question in pirate speak.",
}
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# Replies that stand for a failure.
NO_MODEL_REPLY = (
    "System: No model loaded. Please load a model via /v1/model/load first. (Mock Mode Active)"
)
NO_MODEL_PREFIX = "System: No model loaded"
INFERENCE_ERROR_PREFIX = "Error during inference"
SYSTEM_PREFIX = "System: "

# Training text and sequences.
END_TOKEN = "<|endoftext|>"
USER_MARK = "<|user|>\n"
ASSISTANT_MARK = "<|assistant|>\n"
MAX_LENGTH = 512
IGNORED_LABEL = -100
BATCH_SIZE = 1
ACCUMULATION = 4
EPOCHS = 3

# Training log.
LOG_MARK = "JSON_LOG:"
PERPLEXITY_BASE = 2.718
LOG_STATUSES = [
    ("Loading Model", "Loading Model..."),
    ("Tokenizing", "Tokenizing..."),
    ("Saving adapters", "Saving Weights..."),
]
LOG_ERROR_PREFIXES = ["Training Error:", "Error:", "No training data"]

# Models, adapters and loading.
DEFAULT_MODEL = "stabilityai/stablelm-zephyr-3b"
LEGACY_ADAPTER = "Legacy Adapter"
ADAPTER_NAME_PATTERN = r"\A[A-Za-z0-9_-]+\z"
LOADING_STATUSES = ["starting", "downloading", "loading"]
LOAD_MILESTONES = [10.0, 20.0, 40.0, 100.0]
OFFLINE_AFTER = 2
DEBOUNCE_MILLIS = 400

# Decode parameters (default, lowest, highest).
DECODE_PARAMS = {
    "temperature": (0.7, 0.1, 2.0),
    "top_p": (0.9, 0.1, 1.0),
    "max_new_tokens": (1024, 1, 8192),
    "top_k": (50, 0, 200),
    "repetition_penalty": (1.1, 1.0, 2.0),
    "min_new_tokens": (0, 0, 512),
}

# Adapter fitting.
ADAPTER_RANK = 8
ADAPTER_ALPHA = 32
ADAPTER_DROPOUT = 0.1
LEARNING_RATE = 2e-4

# The reasons a run cannot start, and the guide's dataset sizes.
BLOCKER_OFFLINE = "The backend is offline."
BLOCKER_NO_EXAMPLES = "Add at least one example to the dataset."
BLOCKER_NO_MODEL = "Choose a base model."
BLOCKER_BAD_NAME = "Use only letters, numbers, dashes and underscores in the adapter name."
BLOCKER_TRAINING = "Already training"
QUICK_TEST_SIZE = 10
CONSISTENT_SIZE = 50
