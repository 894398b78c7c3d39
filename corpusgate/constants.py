"""Fixed values.

Everything in this module must equal the behaviour being reproduced for the
results to match: thresholds, suffix lists, name sets, regex patterns and the
exact wording of every finding. They are stated once here, in natural order.
"""

# --- fixed values: row statistics -------------------------------------------
MIN_TEXT_CHARS = 200          # rows shorter than this are dropped by the eval gate
DEDUP_PREFIX_CHARS = 200      # rows sharing a prefix this long are duplicates
CHARS_PER_TOKEN = 4           # rough characters per token
DEFAULT_SAMPLE_ROWS = 200     # rows sampled per source in sample mode
SHORT_ERROR_SHARE = 0.5
SHORT_WARNING_SHARE = 0.1
DUP_ERROR_SHARE = 0.3
DUP_WARNING_SHARE = 0.05

# --- fixed values: file layout of a dataset ---------------------------------
SHARDABLE_SUFFIXES = (".parquet", ".arrow")
NON_DATA_SUFFIXES = (".md", ".gitattributes", ".png", ".jpg", ".jpeg", ".svg", ".py", ".txt", ".yaml")

# --- fixed values: manifest rules -------------------------------------------
TAKEN_NAMES = ("exp_math", "exp_dummy", "exp_c4_p02", "exp_legal", "exp_nemotron_c4", "exp_txt360_c4")
SEQUENCE_LENGTHS = (1024, 2048, 4096)
DEFAULT_SEQUENCE_LENGTH = 4096
DEFAULT_SPLIT = "train"
HARNESSES = ("lm_eval", "eval_loss")
NAME_MAX_CHARS = 40
WEIGHT_TOLERANCE = 1e-6
TITLE_MIN, TITLE_MAX = 5, 80
STRIPPED_MIN_CHARS = {"description": 20, "hypothesis": 30, "evidence": 4, "contamination": 10}
MAX_SOURCES, MAX_BENCHMARKS = 4, 5
PROPOSAL_SUFFIX = ".yaml"

# Patterns, written for Java regex. `\n?\z` stands for Python's `$` (which
# also matches before one final newline); `(?U)` makes `\w` Unicode-aware
# like Python's.
# Repeated groups are possessive: Java's matcher then needs no stack per repetition.
NAME_PATTERN = r"^exp_[a-z0-9]++(?:_[a-z0-9]++)*+\n?\z"
HUB_PATH_PATTERN = r"(?U)^[A-Za-z0-9][\w.-]*/[\w.-]+\n?\z"
SHA_PATTERN = r"^[0-9a-f]{40}\n?\z"
# `{column}` placeholders in a text template, ignoring `{{` escapes.
TEMPLATE_FIELD_PATTERN = r"(?<!\{)\{([^{}]+)\}"
# A template str.format can fill from named columns: literal text, `{{`, `}}`
# and plain `{name}` fields only (no attribute, index, conversion or spec).
TEMPLATE_VALID_PATTERN = r"^(?:[^{}]++|\{\{|\}\}|\{[^{}.\[:!]+\})*+\z"
TEMPLATE_TOKEN_PATTERN = r"\{\{|\}\}|\{([^{}]+)\}"

# --- fixed values: change-log rules -----------------------------------------
MAINTAINER_ASSOCIATIONS = ("OWNER", "MEMBER", "COLLABORATOR")
SUBMITTING_STATUSES = ("A", "M", "R", "C", "T", "")
RENAME_STATUSES = ("R", "C")
PROPOSALS_FOLDER = "proposals"

# --- fixed values: task-config export ---------------------------------------
EXPORT_PER_DEVICE_TRAIN_BATCH_SIZE = 1
EXPORT_BATCH_SIZE = 4
EXPORT_SEEDED_SHARD_PICK = False
EXPORT_SKIP_MAX = 1_000_000

# --- fixed values: validation message texts (library wording) ---------------
MSG_REQUIRED = "Field required"
MSG_GT0 = "Input should be greater than 0"
MSG_GE0 = "Input should be greater than or equal to 0"
MSG_LE1 = "Input should be less than or equal to 1"
MSG_HARNESS = "Input should be 'lm_eval' or 'eval_loss'"
MSG_STR_MIN = "String should have at least {n} characters"
MSG_STR_MAX = "String should have at most {n} characters"
MSG_LIST_MIN = "List should have at least 1 item after validation, not 0"
MSG_LIST_MAX = "List should have at most {n} items after validation, not {k}"
VALUE_ERROR = "Value error, "

# --- fixed values: rule message texts ---------------------------------------
MSG_HUB_PATH = "{value!r} is not a HuggingFace dataset id like 'org/name'"
MSG_REVISION = "revision must be a full 40-character commit sha"
MSG_ONE_RENDERING = ("{path}: set either `text_column` (the column is the text) or "
                     "`text_template` (several columns rendered into one), not both and not neither")
MSG_NO_PLACEHOLDER = "{path}: text_template has no {{column}} placeholder — use text_column if the text is one column"
MSG_BAD_TEMPLATE = "{path}: text_template is not a valid format string ({detail})"
MSG_SEQ_LEN = "sequence_length must be one of (1024, 2048, 4096)"
MSG_WEIGHTS = "dataset_sources weights must sum to 1.0 (they sum to {total})"
MSG_TWICE = "dataset source {key} is listed twice"
MSG_NEEDS_TASK = "benchmark {name!r}: an lm_eval benchmark needs `task`"
MSG_NEEDS_SHOTS = "benchmark {name!r}: an lm_eval benchmark needs `num_fewshot`"
MSG_EVAL_LOSS = ("benchmark {name!r}: eval_loss has no lm-eval task or few-shot count; "
                 "remove `task` / `num_fewshot`")
MSG_NAME = ("name must look like exp_<words> (lowercase letters, digits, single "
            "underscores, at most 40 characters)")
MSG_TAKEN = "{name!r} is already a task on the subnet; pick another name"
MSG_BENCH_UNIQUE = "benchmark names must be unique"
MSG_HELD_OUT = ("benchmark {name!r} scores on {path} split {split!r}, which is also a training source — "
                "the expert would be graded on data it trained on")
MSG_FILE_NAME = "{label}: the file must be named after the proposal's name ({name}.yaml)"
MSG_FOLDER = ("{label}: proposer.github is {github!r} but the file is in {folder}/ — "
              "the folder must be the proposer's GitHub login")
MSG_TWO_OWNERS = "{name}: proposed by more than one person ({owners}); task names must be unique"
MSG_LAYOUT = "{root}/{rel}: only <github-login>/<task-name>.yaml files belong here"

# --- fixed values: data-check message texts ---------------------------------
MSG_NOT_ON_HUB = "{what} does not exist on the Hub (or is private)"
MSG_HUB_STATUS = "the Hub answered {code} for {path}"
MSG_UNREACHABLE = "could not reach the Hub: {detail}"
MSG_DISABLED = "{path} is disabled on the Hub"
MSG_GATED_SOURCE = ("{path} is gated ({gated}): every miner and validator must accept its "
                    "terms on HuggingFace before the task runs. Its rows were not checked.")
MSG_GATED_BENCH = "{path} is gated ({gated}); the owner needs access to score it"
MSG_ONE_FILE = ("{path} is published as {n} file(s) ({files}) in a format a "
                "streaming reader cannot read a piece at a time; every miner would pull and parse the "
                "whole file each round. Prefer a parquet-sharded export.")
MSG_STALL = "{detail}; a miner's dataloader would stall the same way"
MSG_CANNOT_STREAM = "cannot be streamed: {detail}"
MSG_HUB_LISTS = "{msg}. The Hub lists: {pairs}"
MSG_LOADING_SCRIPT = ("{path} uses a loading script, which current `datasets` refuses to run. "
                      "Use a parquet export.")
LOADING_SCRIPT_MARK = "scripts are no longer supported"
LOAD_MSG_MAX_CHARS = 300
HUB_LIST_MAX_PAIRS = 12
MSG_ZERO_ROWS = "split {split!r} streamed zero rows"
MSG_MISSING_COLUMNS = "{what} {missing}; the columns are {columns}"
MSG_NON_TEXT = ("{column!r} is not text in {k} of {n} rows; "
                "use a text column, or a text_template that renders one")
MSG_SHORT_ERROR = ("{pct} of sampled rows are under 200 characters; "
                   "the validator's eval drops those, so there would be too little to score on")
MSG_SHORT_WARNING = "{pct} of sampled rows are under 200 characters and would be dropped from evaluation"
MSG_DUP_ERROR = ("{pct} of sampled rows share their first 200 characters with another row; "
                 "the eval would measure memorising a few documents")
MSG_DUP_WARNING = "{pct} of sampled rows share a 200-character prefix"
MSG_OK_COLUMN = "streams, and {column!r} is usable text ({n} rows sampled)"
MSG_OK_TEMPLATE = "streams, and text_template over {columns} renders usable text ({n} rows sampled)"
MSG_BENCH_TIMEOUT = "{detail}; could not confirm the split is readable"
MSG_BENCH_UNREADABLE = "scored split cannot be read: {detail}"
MSG_BENCH_EMPTY = "split {split!r} of {path} is empty"
MSG_NO_TASK = ("lm-eval has no task {task!r}. If it is a custom task, say so in the PR "
               "and include its YAML; the owner will review it.")
MSG_TASK_UNVERIFIED = "{path} / {split} is readable (lm-eval task {task!r} not verified: lm-eval is not installed)"
MSG_TASK_KNOWN = "{path} / {split} is readable and lm-eval knows {task!r}"
MSG_HELD_OUT_LOSS = "{path} / {split} is readable for a held-out loss"

# --- fixed values: report texts ---------------------------------------------
LEVEL_ICONS = {"error": "❌", "warning": "⚠️", "ok": "✅"}
CONSOLE_MARKS = {"error": "✗", "warning": "!", "ok": "✓"}
CONSOLE_WELL_FORMED = "✓ {n} proposal(s) well-formed: {files}"
CONSOLE_CHECKING = "… checking that {name}'s data can run (this streams from the Hub)"
EXPORT_HEADER = ("#\n# STILL NEEDED before this can be scheduled: expert_assignment.json from\n"
                 "# profiling the base model on these sources, and an entry in\n"
                 "# configs/task_schedule.yaml. Check group_id is not already taken.\n#\n"
                 "# Benchmarks the proposal will be judged on:\n")
REPORT_PASS = "✅ **The data can run.**"
REPORT_FAIL = "❌ **The data cannot run as proposed.**"
REPORT_TITLE = "### Dataset check: `{name}`"
REPORT_TABLE_HEAD = ("| | Subject | Result |", "|---|---|---|")
REPORT_STATS_HEAD = ("**Sampled rows**",
                     "| Source | Rows read | Median chars | Under 200 chars | Duplicate prefixes | Longer than one window |",
                     "|---|---|---|---|---|---|")
NOTHING_TO_REPORT = "✅ Nothing to report.\n"
SUBMISSION_TITLE = "### Submission rules"
MSG_NO_FILES = "this pull request changes no files"
MSG_OUTSIDE = ("`{path}` is outside proposals/<your-login>/ — only "
               "`proposals/{author}/<task-name>.yaml` may change")
MSG_OTHER_FOLDER = "`{path}` is in `{folder}`'s folder — you may only add files under `proposals/{author}/`"
MSG_NOT_YAML_FILE = ("`{path}` is not a `.yaml` file — a submission is a single "
                     "`<task-name>.yaml` and nothing else")
MSG_MANY_PROPOSALS = ("this pull request adds or edits {n} proposals ({paths}); "
                      "open one pull request per proposal so each collects its own votes")
SUBMISSION_MAINTAINER = ("✅ @{author} is a maintainer (association {association}{trusted}); "
                         "the file rules do not apply.")
SUBMISSION_TRUSTED_NOTE = ", on the trusted list"
SUBMISSION_CLEAN = "✅ Only `proposals/{author}/` changed, and only a `.yaml` proposal."
SUBMISSION_BAD = "❌ **This pull request changes files its author may not change.**"
SUBMISSION_FOOTER = "A submission is exactly one file, `proposals/{author}/<task-name>.yaml`.{hint}"
PROBLEMS_TITLE = "### Proposal file check"
PROBLEMS_BAD = "❌ **The proposal file has problems:**"
