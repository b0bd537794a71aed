"""Settings of the engine: column names, thresholds and metric switches."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class McqColumns:
    """Names of the columns of an MCQ table."""

    id: str = "id"
    question: str = "question"
    option_a: str = "option_a"
    option_b: str = "option_b"
    option_c: str = "option_c"
    option_d: str = "option_d"
    correct: str = "correct_option"
    context: str = "content_gpt"

    @property
    def options(self) -> tuple[str, str, str, str]:
        return self.option_a, self.option_b, self.option_c, self.option_d


#: The usual English stop words. Tokens hold no apostrophes, so contractions stand as their parts.
STOPWORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)


@dataclass(frozen=True)
class MetricConfig:
    """Which metrics ``evaluate`` appends; every switch adds one column."""

    columns: McqColumns = field(default_factory=McqColumns)
    originality: bool = True
    readability: bool = True
    negation: bool = True
    is_question: bool = True
    relevance: bool = False
    ambiguity: bool = False
    answerability: bool = False
    disclosure: bool = False
    difficulty: bool = False
    distractors_quality: bool = False
    stopwords: tuple[str, ...] = STOPWORDS
    #: (form, lemma) pairs for tokens that are no stop words; a small table, which becomes part of the plan.
    lemmas: tuple[tuple[str, str], ...] = ()
    #: Answerability prompts would leak the key if they held the correct option.
    include_correct_option: bool = False
    #: Metric -> name of its column, where it is not the usual one.
    names: Mapping[str, str] = field(default_factory=dict)

    def out(self, metric: str) -> str:
        """The name of a metric's column."""
        return self.names.get(metric, OUTPUTS.get(metric, metric))


#: Columns that are not named after their metric.
OUTPUTS = {"negation": "starts_with_negation", "answerability": "gpt_answer"}

#: A generated MCQ is good above this score; an unknown score is not good.
QUALITY_THRESHOLD = 2
#: A regenerated MCQ is accepted from this score on, within so many attempts.
ACCEPT_MIN = 2
MAX_ATTEMPTS = 3
SEED = 42
#: Held-out share of a preference set, and its largest size.
PAIR_EVAL_SHARE, PAIR_EVAL_MAX = 10, 200
EVAL_FRACTION = 0.2
TEST_FRACTION = 0.3
