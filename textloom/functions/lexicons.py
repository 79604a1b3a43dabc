"""Word lists and patterns of the signals."""

# Results depend on exactly these phrases, words and patterns.
FILLER_PHRASES = [
    "it is important to note", "in today's digital landscape", "plays a crucial role", "enhance user experience", "seamless experience", "various aspects",
    "robust solution", "comprehensive overview", "in conclusion", "this article explores", "delve into", "unlock the power", "game changer", "cutting edge",
    "it's worth noting", "it goes without saying", "needless to say", "at the end of the day", "when it comes to", "in terms of", "in order to",
    "as a matter of fact", "it should be noted", "leverage", "streamline", "synergy", "paradigm shift", "holistic approach", "moving forward", "going forward",
    "at scale", "best-in-class", "world-class", "state-of-the-art", "cutting-edge solution", "innovative approach", "transformative", "revolutionize", "empower",
    "foster", "cultivate", "spearhead", "drive growth", "value proposition", "deep dive", "circle back", "touch base", "take it to the next level",
    "low-hanging fruit", "think outside the box", "push the envelope", "move the needle", "raise the bar", "best practices", "key takeaway",
    "actionable insights", "elevate your", "navigate the complexities", "tapestry of", "landscape of", "realm of possibilities", "underscore the importance",
    "it's important to remember", "without further ado", "a testament to",
]
STOP_WORDS = (
    "a about above after again against all also am an and any are aren't as at be been before being below between both but by can could couldn't did didn't do does "
    "doesn't doing don't down during each few for from further get got had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in "
    "into is isn't it its itself just let ll me might more most must mustn't my myself no nor not now of off on once only or other ought our ours ourselves out over own "
    "re s same shall shan't she should shouldn't so some such t than that the their theirs them themselves then there these they this those through to too under until "
    "up us ve very was wasn't we were weren't what when where which while who whom why will with won't would wouldn't you your yours yourself yourselves"
).split()
#: Words that the novelty curve passes over.
CURVE_STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had "
    "what when where who which why how all each every both few more most other some such than too very can could may might must "
    "shall should would or not no nor if then so because as until while about after before between into through during above below up down "
    "out off over under again further once here there all any both each few more most other some such only own same than too very just "
    "now also been being do does did doing get got getting make made making go going went gone come came coming take took taken taking "
    "see saw seen seeing know knew known knowing think thought thinking say said saying tell told telling use used using find found finding "
    "give gave given giving work worked working"
).split()
TRANSITIONS = [
    "furthermore", "additionally", "moreover", "in addition", "in summary", "to summarize", "in conclusion", "to conclude", "as mentioned", "as noted above",
    "as previously stated", "it is worth mentioning", "on a related note", "with that said", "that being said", "having said that", "all things considered",
    "by the same token", "equally important", "last but not least",
]
CONCRETE = [
    r"\b\d+(\.\d+)?%?\b", r"\b[A-Z][a-z]+[A-Z][A-Za-z]*\b", r"`[^`]+`", r"\b[A-Za-z0-9_\-/]+\.(ts|tsx|js|jsx|py|go|java|md|json|yml|yaml)\b",
    r"(?i)\b(error|exception|latency|timeout|memory|cpu|endpoint|api|schema|migration)\b", r"\b[a-z]{2,}_[a-z][a-z_]{3,}\b", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    r"(?i)\b[a-f0-9]{8,}\b", r"\b[a-z][a-z0-9_-]{4,}/[a-z][a-z0-9_-]{2,}\b", r"\b[a-z][a-zA-Z]{3,}[A-Z][a-zA-Z]+\b", r"\b[Pp]\d{2,}\b", r"\b\d{2,}[,\.]\d{3,}\b",
    r"(?i)\b(?:CVE|SEC|PR|GH)-\d{4}-\d{3,}\b", r"(?i)\b\d+(?:\.\d+)?\s*(?:ms|s|sec|min|hr|kb|mb|gb|tb|px|%|x|rps|ops|qps|fps|ns|us)\b",
    r"\b(?:Redis|Kafka|Postgres|MySQL|MongoDB|DynamoDB|CloudWatch|Datadog|Sentry|Grafana|Prometheus|Elasticsearch|Kibana|S3|Lambda|RDS|SQS|SNS|Supabase|Firebase|Stripe|Twilio)\b",
]
JARGON = [
    "optimized", "performance", "efficiency", "scalable", "scalability", "robust", "resilient", "reliable", "maintainable", "flexible", "modular", "extensible",
    "elegant", "clean", "sophisticated", "enterprise-grade", "production-ready", "battle-tested", "hardened", "streamlined", "best-in-class", "world-class",
    "cutting-edge", "innovative", "transformative", "revolutionary", "disruptive", "synergistic", "holistic", "comprehensive", "end-to-end", "query planner",
    "query optimizer", "execution plan", "index scan", "covering index", "composite index", "b-tree", "hash index", "connection pool", "thread pool", "goroutine",
    "async", "non-blocking", "event-driven", "reactive", "microservice", "service mesh", "load balancer", "circuit breaker", "rate limiter", "throttling",
    "caching layer", "in-memory cache", "distributed cache", "data pipeline", "stream processing", "batch processing", "machine learning", "deep learning",
    "neural network", "AI-powered", "intelligent", "smart", "automated", "self-healing", "self-optimizing",
]
EVIDENCE = [
    r"(?i)\b\d+(\.\d+)?\s*(?:ms|s|sec|min|hr|mb|gb|tb|%|x|times|rps|ops|qps|fps)\b", r"\b\d{2,}[,\.]\d{3,}\b", r"\b[Pp]\d{2,}\b",
    r"(?i)(?:reduced|decreased|improved|increased|dropped|grew|cut|saved|sped)\s+(?:by\s+)?\d+", r"(?i)(?:from|down\s+from)\s+\d+\s+(?:to|down\s+to)\s+\d+",
    r"(?i)(?:bench|profil|flamegraph|perf|test|load\s*test)\s*(?:show|indicate|reveal|measur)", r"(?i)(?:before|after|pre[- ]patch|post[- ]patch)\s*:\s*\d+",
]
DOMAINS = ["code_review", "docs", "hiring", "communications", "content", "academia", "marketplace", "social_news", "general"]

#: Sentences of our own that touch the lists above; queries append them to documents, whose prose is invented.
SAMPLES = [
    "The retry loop cut p95 latency from 420 ms to 85 ms after we moved the session cache to Redis. We measured it twice.",
    "It is important to note that this robust solution will leverage best practices. Furthermore, it is a testament to synergy.",
    "Moreover, the service is scalable and reliable. I think it is fine, but you should check `pool_size` in config/settings.py.",
    "There is a holistic approach here. There is a value proposition here. There is a deep dive here. In conclusion, there is growth.",
    "We rejected the first design because the migration locked 12,500 rows; our fix batches them.",
]

#: Words that a mined phrase must hold (as part of it); the reference's filler words.
FILLER = [
    "ensure", "enhance", "improve", "robust", "seamless", "leverage", "comprehensive", "innovative", "streamline", "empower", "harness", "cutting-edge", "state-of-the-art", "best practices",
    "going forward", "moving forward", "in today", "crucial role", "key aspect", "various aspects", "overall", "effectively", "efficiently",
]

#: Phrases that are known slop already; the reference's pattern.
KNOWN_SLOP = (
    r"(?i)"
    r"\b(?:in today's\s*(?:fast[- ]paced\s*)?world|"
    r"it(?:'s|\s+is)\s+(?:important|crucial|essential|worth\s+noting)\s+(?:to\s+)?note|"
    r"dive\s+(?:deep\s+)?(?:into|in)|"
    r"let(?:'s|\s+us)\s+(?:dive|explore|delve)|"
    r"in\s+this\s+(?:article|blog\s*post|guide|tutorial|deep\s*dive)|"
    r"whether\s+you(?:'re|\s+are)\s+a\s+(?:seasoned|beginner|junior|senior)|"
    r"buckle\s+up|"
    r"without\s+further\s+ado|"
    r"at\s+the\s+end\s+of\s+the\s+day|"
    r"in\s+conclusion|to\s+(?:sum\s+up|wrap\s+up|conclude)|"
    r"delve\s+(?:into|deeper)|"
    r"a\s+testament\s+to|"
    r"tapestry\s+(?:of|in)|"
    r"rich\s+(?:history|ecosystem|landscape|tapestry)|"
    r"game[- ]changer|game[- ]changing|"
    r"cutting[- ]edge|state[- ]of[- ]the[- ]art|"
    r"revolutionize|transformative|paradigm\s*shift|"
    r"robust\s+(?:solution|framework|toolset|architecture)|"
    r"seamless\s*(?:integration|experience|workflow)|"
    r"empower(?:s|ing|ed)?\s+(?:users|teams|developers|organizations)|"
    r"harness\s+(?:the\s+power\s+of|the\s+potential\s+of)|"
    r"unlock\s+(?:the\s+potential|new\s+possibilities|insights)|"
    r"streamline\s+(?:your|the)\s+(?:workflow|process|operations)|"
    r"leverage\s+(?:our|this|the)\s+(?:powerful|robust|advanced)|"
    r"comprehensive\s+(?:guide|solution|overview|analysis)|"
    r"nuanced\s+(?:understanding|approach|perspective)|"
    r"intricate\s+(?:details|relationship|web|dance)|"
    r"meticulously\s+(?:crafted|designed|curated)|"
    r"testament\s+(?:to\s+the|of\s+the)|"
    r"stands\s+as\s+a\s+testament|"
    r"plays\s+a\s+(?:crucial|vital|pivotal|essential)\s+role|"
    r"it\s+is\s+worth\s+noting\s+that|"
    r"it\s+is\s+important\s+to\s+(?:note|understand|recognize)|"
    r"as\s+(?:an?\s+)?AI\s+(?:language\s+)?model|"
    r"as\s+a\s+(?:large|generative)\s+(?:language|AI)\s+model)\b"
)
