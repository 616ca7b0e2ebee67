"""Default rule tables.

Fixed values: every list, table and pattern in this module is data that results
depend on, kept plainly and in natural order.  All operators take them as
arguments, so any of them can be replaced per call.
"""

# ---------------------------------------------------------------- ingestion

COLUMN_ALIASES = {
    "candidate_id": ["candidate_id", "id", "applicant_id"],
    "name": ["name", "full_name", "candidate_name", "applicant_name"],
    "email": ["email", "email_address", "contact_email"],
    "role": ["role_applied_for", "role", "position", "job_title"],
    "github_url": ["github_url", "github", "github_profile"],
    "linkedin_url": ["linkedin_url", "linkedin", "linkedin_profile"],
    "response_time_seconds": ["response_time_seconds", "response_time", "time_taken"],
}

# Cell values the pandas CSV reader documents as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ------------------------------------------------------------------ scoring

DIMENSIONS = [
    "technical_relevance", "answer_quality", "profile_credibility",
    "specificity", "timing",
]

WEIGHTS = {
    "technical_relevance": 0.30,
    "answer_quality": 0.25,
    "profile_credibility": 0.20,
    "specificity": 0.15,
    "timing": 0.10,
}

TIERS = ["Fast-Track", "Standard", "Review", "Reject"]

DEFAULT_ROLE = "ai_agent_developer"

ROLE_TERMS = {
    "ai_agent_developer": [
        "langchain", "rag", "retrieval", "embedding", "vector", "transformer",
        "fine-tuning", "fine tuning", "prompt engineering", "llm", "gpt",
        "agent", "tool calling", "function calling", "chain of thought",
        "openai", "anthropic", "huggingface", "tokenizer", "attention",
        "celery", "redis", "kafka", "flink", "api", "fastapi", "flask",
        "docker", "kubernetes", "ci/cd", "pipeline", "dag",
        "postgres", "mongodb", "redis", "sqlite", "dynamodb",
        "latency", "throughput", "p99", "p95", "benchmark",
        "precision", "recall", "f1", "rmse", "accuracy",
        "cosine similarity", "cross-encoder", "reranker",
        "async", "concurrent", "threading", "multiprocessing",
    ],
}

# (at least this many distinct terms, base score), highest first; else 10
TERM_LADDER = [(15, 90), (10, 75), (5, 55), (2, 35)]
TERM_FLOOR = 10
VERSION_PATTERN = r"[a-zA-Z]+[\s-]?v?\d+\.?\d*"
VERSION_POINTS = 2

# (at most this many words, points), shortest first; else 80
LENGTH_LADDER = [(5, 5), (20, 20), (50, 50), (150, 70)]
LENGTH_TOP = 80

# (pattern, bonus before the factor of 5)
QUALITY_RULES = [
    (r"\d+%", 0.5),
    (r"\d+ms|\d+s\b|\d+ seconds", 0.3),
    (r"\$\d+", 0.3),
    (r"\([\d]+\)", 0.2),
    (r"tried|attempted|experimented", 0.4),
    (r"failed|broke|didn't work|dropped", 0.3),
    (r"because|since|the reason", 0.2),
    (r"trade-?off|versus|vs\.?", 0.3),
    (r"lesson|learned|realized|key insight", 0.3),
]
QUALITY_FACTOR = 5

FAKE_HANDLE_TOKENS = ["test", "example", "null", "none", "fake", "asdf", "404"]
WORK_REFERENCES = ["github", "repo", "repository"]

GENERIC_PHRASES = [
    "i am a fast learner",
    "passionate about technology",
    "i am passionate about",
    "great work in this space",
    "i think this company",
    "i am interested in",
    "depending on requirements",
    "i would use",
    "it was challenging",
    "i learned that",
    "best practices",
    "industry standard",
    "cutting edge",
    "state of the art",
    "leverage my skills",
    "team player",
    "hard worker",
    "detail oriented",
    "think outside the box",
]

# (pattern, what the explanation calls it)
CONCRETE_PATTERNS = [
    (r"\d+\.?\d*%", "specific percentages"),
    (r"\b\d+k\b|\b\d+K\b|\b\d+M\b", "scale numbers"),
    (r"\b(built|deployed|implemented|created|designed)\b", "action verbs"),
    (r"\b(at my|at our|in my|in our)\b", "personal experience references"),
]

# (below this many seconds, score), fastest first; <= 0 and the rest score 50
TIMING_LADDER = [(10, 15), (30, 40), (60, 65), (300, 85), (600, 70)]
TIMING_NEUTRAL = 50

# (at least this total, tier), best first; else Reject
TIER_LADDER = [(85, "Fast-Track"), (65, "Standard"), (45, "Review")]
REJECT_FLAGS = ["CHEAT_DETECTED", "COPIED_RESPONSE"]

# ---------------------------------------------------------------- forensics

AI_TRANSITIONS = [
    "moreover", "furthermore", "additionally", "consequently",
    "in conclusion", "it is important to note", "it's worth noting",
]

FORMAL_PATTERNS = [
    r"\bthis ensures\b", r"\bthis allows\b", r"\bthis enables\b",
    r"\bit is essential\b", r"\bit is crucial\b",
]

CONTRACTION_PATTERN = r"\b\w+'\w+\b"
TOKEN_PATTERN = r"\b\w\w+\b"

SIMILARITY_HIGH = 0.92
SIMILARITY_WARN = 0.80
STRIKE_LIMIT = 3
MAX_FEATURES = None

# --------------------------------------------------------------- engagement

THREAD_STATES = [
    "initiated", "awaiting_reply", "replied", "follow_up_sent",
    "completed", "stalled", "eliminated",
]
CLOSED_STATES = ["completed", "stalled", "eliminated"]
WAITING_STATES = ["awaiting_reply", "follow_up_sent"]
TIMEOUT_HOURS = 48
MAX_ROUNDS = 3

CODE_MARKERS = [
    "```", "def ", "class ", "import ", "function ", "const ", "var ", "let ",
]

VAGUE_PHRASES = [
    "i am interested", "i am passionate", "i would like to",
    "thank you for", "thanks for", "i appreciate",
    "sounds good", "sounds great", "that's interesting",
]

TECH_PATTERNS = [
    r"\b(api|sdk|runtime|compile|debug|deploy|test|benchmark)\b",
    r"\b(algorithm|data structure|complexity|o\(n\)|o\(log|hash|tree|graph)\b",
    r"\b(docker|kubernetes|aws|gcp|azure|terraform|ci\/cd)\b",
    r"\b(database|sql|nosql|index|query|cache|redis)\b",
    r"\b(neural|model|training|inference|embedding|vector)\b",
    r"\d+%|\d+ms|\d+\.\d+",
]

# (response_type, action, template, advance_round, description)
DECISIONS = [
    ("technical", "ask_deeper", "technical_followup", True,
     "Good technical answer -> ask a harder/deeper question"),
    ("vague", "probe", "probe_specifics", False,
     "Vague answer -> ask for specific examples or details"),
    ("code_submission", "evaluate_and_respond", "code_feedback", True,
     "Code submitted -> acknowledge + ask about design decisions"),
    ("question", "answer_and_redirect", "answer_question", False,
     "Candidate asked a question -> answer briefly + redirect to next question"),
    ("off_topic", "redirect", "redirect_topic", False,
     "Off-topic -> acknowledge + guide back to assessment"),
    ("minimal", "request_elaboration", "request_more", False,
     "Minimal response -> ask them to elaborate"),
]

TEMPLATES = {
    "initial_outreach": """Hi {name},

Thank you for applying for the {role} position. We'd like to learn more about your experience through a brief technical discussion.

Here's our first question:

{question}

Take your time — we value thoughtful responses over quick ones. Reply directly to this email.

Best,
Hiring Team""",
    "technical_followup": """Hi {name},

Great answer on {previous_topic}. {specific_feedback}

Let's go a bit deeper:

{question}

Best,
Hiring Team""",
    "probe_specifics": """Hi {name},

Thanks for your response. I'd like to understand your experience more concretely.

Could you share a specific example? For instance:
- What was the exact problem you were solving?
- What tools/technologies did you use?
- What was the measurable outcome?

Looking forward to hearing the details.

Best,
Hiring Team""",
    "code_feedback": """Hi {name},

Thanks for sharing your code. {code_feedback}

A follow-up question about your implementation:

{question}

Best,
Hiring Team""",
    "answer_question": """Hi {name},

Good question! {answer_to_question}

Now, for the next part of our assessment:

{question}

Best,
Hiring Team""",
    "request_more": """Hi {name},

Thanks for your reply. Could you elaborate on your answer? We're looking for specific details about your approach, the tools you used, and what you learned.

A few sentences with concrete examples would be great.

Best,
Hiring Team""",
    "stalled_followup": """Hi {name},

Just checking in — we haven't heard back from you on our last message. No worries if you need more time.

If you're still interested in the {role} position, just reply to continue the conversation. We'll keep your thread open for another 48 hours.

Best,
Hiring Team""",
}

QUESTIONS = {
    1: "What's a real-world system you've built or contributed to that involved autonomous decision-making? Walk me through the architecture and what you'd change in hindsight.",
    2: "Tell me about a time a system you built failed in production. What was the root cause, how did you detect it, and what did you change?",
    3: "Design a system that processes 50K candidates/year with real-time scoring and async email conversations. What's your architecture, and where are the risks?",
}
FIRST_QUESTION_DEFAULT = "Tell me about your experience."
NEXT_QUESTION_DEFAULT = "Tell me more."

# ----------------------------------------------------------------- learning

TECH_TERM_PATTERN = (
    r"\b(api|model|database|deploy|architecture|pipeline|cache|queue|async|docker|kubernetes)\b"
)
MAX_DELTA = 0.05
WEIGHT_BOUNDS = (0.05, 0.50)

# Grades of sentence variation (below, score, words before and after it), and
# the sentences of machine-text signals.
UNIFORMITY_GRADES = [
    (0.2, 0.85, "Very uniform sentence lengths (CV=", ") — strong AI signal"),
    (0.35, 0.5, "Somewhat uniform sentences (CV=", ") — mild AI signal"),
    (float("inf"), 0.1, "Natural sentence variation (CV=", ") — likely human"),
]
SHORT_FOR_UNIFORMITY = "Text too short for uniformity analysis"
FEW_SENTENCES = "Too few sentences for analysis"
SHORT_FOR_VOCABULARY = "Text too short for vocabulary analysis"
NO_VOCABULARY_SIGNALS = "No AI vocabulary signals"

# Fixed value: why a batch wrote a new version of the weights.
SNAPSHOT_REASON = "batch_analysis_auto_adjustment"
