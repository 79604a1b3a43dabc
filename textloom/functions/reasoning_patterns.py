"""Words and patterns of the claim verifier, the reasoning signal and the improvement hints. All match without case unless stated."""

# Results depend on exactly these words, patterns and numbers.
WHY_MARKERS = [
    "because", "therefore", "so that", "tradeoff", "trade-off", "risk", "chosen", "decided", "reason", "constraint", "avoid", "prevent", "instead", "due to",
    "root cause", "rationale", "motivation", "justify", "justified", "justification", "in order to", "as a result", "consequently", "hence", "thus", "since",
    "given that", "on the grounds that", "for this reason", "the goal is", "the idea is", "this ensures", "this prevents", "this avoids", "this reduces",
    "this mitigates", "otherwise", "the concern is", "the problem is", "the issue is", "we need to", "the downside", "the upside",
]
CAUSAL = r"\bbecause\b|\btherefore\b|\bconsequently\b|\bas a result\b|\bhence\b|\bthus\b|\bsince\b|\bgiven that\b|\bdue to\b|\s[—–]\s"
CONDITIONAL = [r"\bif\b.{3,60}\bthen\b", r"\bwhen\b.{3,60}\bbecause\b", r"\bsince\b.{3,60}\bwe\b"]
COMPARATIVE = [r"\bbetter than\b", r"\bworse than\b", r"\bcompared to\b", r"\binstead of\b", r"\brather than\b", r"\bas opposed to\b"]
TRADEOFF = [r"\bpros and cons\b", r"\bon one hand\b", r"\bthe downside\b", r"\bthe upside\b", r"\btrade-?off\b", r"\bweigh(ing)?\b"]
BEFORE_AFTER = [
    r"\b(?:before|after|pre[- ]patch|post[- ]patch|previously|originally)\b.*?\b\d+",
    r"\b(?:from|down\s+from|reduced\s+from)\s+\d+.*?\b(?:to|down\s+to)\s+\d+",
]

#: What parts a claim from its reason; a "that" before " means" or before an apostrophe and a blank does not.
CONNECTIVE = r"\s+\bbecause\b|\s+\bwhich\b|\s+\bthat\b(?!\s+means|'\s)|\s*[—–]\s*|\s*---\s*"

HEDGES = [
    "might", "could", "potentially", "possibly", "seems", "appears", "perhaps", "maybe", "somewhat", "relatively", "generally", "typically", "usually", "often",
    "likely", "unlikely", "probably",
]

#: (words before the repeated word, words behind): a word that explains itself.
TAUTOLOGIES = [
    r"\b(\w+)\s+to\s+(?:fix|resolve|improve|update|change)\s+\1\b", r"\bupdated\s+(\w+)\s+because\s+\1\b", r"\bchanged\s+(\w+)\s+to\s+fix\s+\1\b",
    r"\b(\w+)\s+(?:is|was)\s+\1(?:er|ed)?\b",
]

#: One of each kind counts, however often it comes.
HIGH = {
    "numeric_measurement": (
        r"\d+(?:\.\d+)?\s*(?:ms|s|sec|min|hr|hour|kb|mb|gb|tb|px|%|x|times|deg|fps|"
        r"requests?/sec|rps|ops|qps|mb/s|gb/s|ns|μs|us|seconds?|minutes?|hours?|"
        r"bytes?|kilobytes?|megabytes?|gigabytes?|terabytes?|"
        r"milliseconds?|microseconds?|nanoseconds?|"
        r"lines?|chars?|chars?/sec|words?|tokens?|"
        r"deps?|dependencies?|files?|modules?|packages?|"
        r"users?|accounts?|sessions?|connections?|"
        r"requests?|responses?|queries?|mutations?|"
        r"rows?|records?|entries?|items?|"
        r"clusters?|nodes?|pods?|instances?|"
        r"threads?|processes?|goroutines?|"
        r"ms\b|kb\b|mb\b|gb\b|tb\b|\d+x\b|\d+%)"
    ),
    "error_code_or_identifier": (
        r"(?:TypeError|SyntaxError|ReferenceError|RangeError|TypeError|URIError|"
        r"ValueError|KeyError|IndexError|AttributeError|ImportError|"
        r"FileNotFoundError|ModuleNotFoundError|StopIteration|"
        r"CVE-\d{4}-\d{4,}|PR-\d{3,}|GH-\d{3,}|SEC-\d{3,}|"
        r"error\s*(?:code\s*)?#?\d{3,}|"
        r"status\s*(?:code\s*)?\d{3}|"
        r"exit\s*code\s*\d+|"
        r"(?:HTTP|https?)\s*(?:status\s*)?(?:code\s*)?\d{3}|"
        r"issue\s*#?\d{2,}|\bfixes?\s*#?\d{2,}|\bcloses?\s*#?\d{2,}|"
        r"line\s+\d+|"
        r"lines?\s+\d+(?:\s*[-–]\s*\d+)?)"
    ),
    "tool_reference": (
        r"\b(?:profiling|benchmark|test output|test suite|linter|eslint|prettier|"
        r"prettier|webpack|rollup|vite|esbuild|tsc|babel|jest|mocha|pytest|"
        r"cargo|npm|yarn|pnpm|pip|docker|kubernetes|kubectl|helm|terraform|"
        r"ansible|jenkins|github actions|ci/cd|coverage|codecov|sonar|"
        r"bundle\s*(?:analysis|size|analyzer)|heap\s*(?:dump|profile)|"
        r"flamegraph|flame\s*graph|perf|performance\s*(?:test|audit|insight)|"
        r"devtools|chrome\s*(?:dev)?tools|firefox\s*devtools|"
        r"network\s*(?:tab|panel|log)|console\.(?:log|warn|error|debug)|"
        r"linting|static\s*analysis|type\s*check(?:ing)?|"
        r"tree[- ]shak(?:e|ing)|code\s*split(?:ting)?|dead\s*code|"
        r"main\s*chunk|vendor\s*chunk|asset\s*module|"
        r"hot\s*module\s*replacement|HMR|live\s*reload|"
        r"source\s*map|minif(?:y|ication)|transpil(?:e|ation)|"
        r"memoiz(?:e|ation)|debounce|throttle|"
        r"cache\s*(?:hit|miss|invalidation|busting)|"
        r"cloudwatch|datadog|splunk|grafana|prometheus|sentry|pagerduty|"
        r"new\s*relic|dynatrace|elastic(?:search)?|kibana|logstash|"
        r"s3|ec2|lambda|rds|dynamodb|sqs|sns|cloudfront|"
        r"gcs|bigquery|pubsub|cloud\s*run|"
        r"azure\s*(?:monitor|devops|functions|blob)|"
        r"supabase|firebase|vercel|netlify|heroku|"
        r"nginx|apache|haproxy|traefik|envoy|istio)\b"
    ),
    "version_reference": r"\b(?:v|version)\s*\d+\.\d+|\bnode\s*\d+\.\d+|\bpython\s*\d+\.\d+",
    "named_codebase_entity": (
        r"(?:function|class|method|component|hook|route|endpoint|handler|"
        r"middleware|plugin|module|service|controller|repository|factory|"
        r"provider|injector|decorator|directive|filter|interceptor|"
        r"resolver|serializer|validator|formatter|parser|compiler|"
        r"transformer|mapper|adapter|wrapper|proxy|stub|mock|fixture|"
        r"test\s*\w+|spec\s*\w+)\s+['\"]?([a-zA-Z_]\w{2,50})['\"]?"
        r"|use[A-Z][a-zA-Z]{2,50}"
        r"|_[a-z][a-z_]{2,50}"
        r"|__[a-z_]{2,50}__"
    ),
    "timestamp_reference": (
        r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
        r"today|yesterday|last\s+(?:week|month|quarter|year|sprint)|"
        r"this\s+(?:week|month|quarter|year|sprint)|"
        r"after\s+(?:the\s+)?(?:deploy|release|merge|push|update|upgrade|migration)|"
        r"before\s+(?:the\s+)?(?:deploy|release|merge|push|update|upgrade|migration)|"
        r"during\s+(?:the\s+)?(?:deploy|release|merge|push|update|upgrade|migration)|"
        r"since\s+(?:version|v|release)\s*[\d.]+)\b"
    ),
    "architectural_pattern": (
        r"\b(?:singleton|observer\s*pattern|factory\s*(?:method)?|"
        r"abstract\s*factory|builder\s*pattern|prototype\s*pattern|"
        r"strategy\s*pattern|command\s*pattern|adapter\s*pattern|"
        r"decorator\s*pattern|facade\s*pattern|proxy\s*pattern|"
        r"bridge\s*pattern|composite\s*pattern|flyweight\s*pattern|"
        r"chain\s*of\s*responsibility|mediator\s*pattern|"
        r"interpreter\s*pattern|iterator\s*pattern|visitor\s*pattern|"
        r"mvc|mvvm|mvp|flux|redux|vuex|ngrx|"
        r"circuit\s*breaker|event\s*sourcing|CQRS|"
        r"saga\s*pattern|two[- ]phase\s*commit|"
        r"pub[- ]?sub|message\s*queue|event\s*bus|"
        r"dependency\s*injection|inversion\s*of\s*control|"
        r"repository\s*pattern|unit\s*of\s*work|"
        r"service\s*layer|domain\s*driven\s*design|"
        r"hexagonal\s*architecture|ports\s*and\s*adapters|"
        r"microservice|serverless|edge\s*function|"
        r"API\s*gateway|BFF|backend\s*for\s*frontend)\b"
    ),
    "failure_mode": (
        r"\b(?:race\s*condition|deadlock|livelock|starvation|"
        r"memory\s*leak|buffer\s*overflow|null\s*(?:pointer\s*)?(?:exception|dereference)|"
        r"off[- ]by[- ]one|N\s*[+−]?\s*1|N\+1\s*query|"
        r"thundering\s*herd|cache\s*(?:storm|avalanche|miss|hit|poisoning)|"
        r"connection\s*(?:pool\s*(?:exhaustion)?|leak|timeout|reset)|"
        r"socket\s*(?:hang\s*up|timeout|refused|error)|"
        r"dns\s*(?:resolution|lookup|failure)|"
        r"SSL|TLS|certificate\s*(?:pinning|expiry|validation)|"
        r"XSS|CSRF|SQL\s*injection|CORS\s*(?:error|policy)|"
        r"stack\s*overflow|heap\s*(?:corruption|exhaustion)|"
        r"thread\s*safety|reentrancy|idempotency|"
        r"blocking\s*(?:call|I/?O)|non[- ]blocking|"
        r"backpressure|congestion\s*control)\b"
    ),
    "comparative_alternative": (
        r"\b(?:instead\s*of|unlike|replacing|replaced\s*(?:with|by)|"
        r"swapped\s*(?:for|with)|migrating\s*(?:from|to)|"
        r"switching\s*(?:from|to)|moving\s*(?:from|to)|"
        r"different\s*(?:from|than)|alternative\s*to)\b"
    ),
    "library_or_package": (
        r"\b(?:moment\.?js|date[- ]fns|dayjs|luxon|lodash|underscore|"
        r"axios|fetch|node[- ]fetch|got|request|"
        r"express|fastify|koa|hapi|nestjs|"
        r"react|vue|angular|svelte|solid|"
        r"redux|mobx|zustand|recoil|jotai|"
        r"webpack|rollup|vite|esbuild|parcel|"
        r"jest|mocha|vitest|cypress|playwright|"
        r"prisma|sequelize|typeorm|drizzle|knex|"
        r"redis|memcached|kafka|rabbitmq|zeromq|"
        r"postgres|mysql|sqlite|mongodb|dynamodb|"
        r"stripe|twilio|sendgrid|auth0|firebase|"
        r"aws|azure|gcp|cloudflare|vercel|netlify)\b"
    ),
}

# File paths, with case: a name with a known extension, two parts with a slash between them, or a rooted path of two parts.
# Only whether one is there counts, so no part is repeated as a group, which would need a stack as deep as the path.
FILE_PATH = (
    r"(?:^|[\s/])[a-zA-Z0-9_.-]+\.(?:js|ts|tsx|jsx|py|rb|go|rs|java|"
    r"c|cpp|h|hpp|cs|rb|php|sh|bash|zsh|fish|ps1|bat|cmd|yaml|yml|json|toml|"
    r"ini|cfg|conf|env|html|css|scss|sass|less|svg|md|rst|txt|log|lock|"
    r"gitignore|dockerignore|env\.\w+)"
    r"|\b[a-zA-Z0-9_.-]+/(?:[.-]++/)*+[.-]*[a-zA-Z0-9_]+\b"
    r"|/\b[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]"
)

MEDIUM = [
    (
        r"\b(?:significantly|substantially|considerably|dramatically|noticeably|"
        r"measurably|markedly|vastly)\s+(?:faster|slower|larger|smaller|"
        r"better|worse|more|less|higher|lower|improved|reduced|increased)\b"
        r"|\b(?:reduced|increased|improved|decreased)\s+by\s+(?:half|a\s+third|"
        r"a\s+quarter|double|triple|\d+\s*%?)\b"
        r"|\b(?:faster|slower|better|worse|larger|smaller)\s+than\s+\b"
    ),
    (
        r"\b(?:race\s*condition|n\s*[-+]?\s*1\s+query|memory\s*leak|"
        r"buffer\s*overflow|null\s*pointer|off\s*by\s*one|"
        r"deadlock|livelock|starvation|thundering\s*herd|"
        r"cache\s*(?:in)?validation|cache\s*miss|cache\s*hit|"
        r"salt(?:ing)?|hash(?:ing)?|encrypt(?:ion)?|decrypt(?:ion)?|"
        r"middleware|interceptor|decorator|singleton|factory\s*method|"
        r"observer\s*pattern|proxy\s*pattern|adapter\s*pattern|"
        r"dependency\s*injection|inversion\s*of\s*control|"
        r"solid\s*principles|dry\s*principle|kiss\s*principle|"
        r"separation\s*of\s*concerns|single\s*responsibility|"
        r"open[/-]closed\s*principle|liskov\s*substitution|"
        r"interface\s*segregation|dependency\s*inversion)\b"
    ),
    (
        r"(?:fixes|closes|resolves|addresses|refs?|related\s+to)\s*#?\d{2,}"
        r"|per\s+[A-Z][a-z]+(?:'[s])?"
        r"|per\s+(?:alice|bob|charlie|dave|eve|frank|grace|heidi|ivan|judy|karl|mallory|oscar|peggy|trent|walter|wendi)"
        r"|per\s+code\s*review"
        r"|as\s+suggested\s+by\s+[A-Z][a-z]+"
        r"|requested\s+by\s+[A-Z][a-z]+"
    ),
]

#: Each match counts once.
LOW = [
    (
        r"\b(?:slow|fast|messy|clean|unclear|clear|better|worse|good|bad|"
        r"nice|ugly|complex|simple|easy|hard|difficult|straightforward|"
        r"elegant|robust|solid|reliable|flexible|scalable|maintainable|"
        r"readable|efficient|optimized|performant|improved|enhanced|"
        r"modern|legacy|old|new|fresh|stale|current|latest)\b"
    ),
    (
        r"\b(?:improves?\s+performance|enhances?\s+readability|"
        r"better\s+maintainability|cleaner\s+approach|"
        r"more\s+efficient|more\s+robust|more\s+reliable|"
        r"improved\s+user\s*experience|enhanced\s+functionality|"
        r"better\s+code\s*quality|improved\s+architecture|"
        r"enhanced\s+security|better\s+error\s*handling|"
        r"improved\s+scalability|better\s+performance)\b"
    ),
    (
        r"\b(?:various|several|multiple|many|some|different|certain|"
        r"appropriate|suitable|relevant|related|corresponding)\b"
        r"\s+(?:reasons?|issues?|problems?|bugs?|changes?|updates?|"
        r"improvements?|fixes?|additions?|removals?|adjustments?)\b"
    ),
]

#: Sounds specific, says nothing.
HOLLOW = (
    r"\b(?:some\s+(?:users|people|developers|teams)|"
    r"certain\s+(?:cases?|scenarios?|situations?|conditions?)|"
    r"in\s+(?:some|many|most|various|certain)\s+(?:cases?|instances?|situations?)|"
    r"(?:can|could|may|might)\s+(?:potentially|possibly|perhaps|likely)\s+(?:be|improve|help|provide)|"
    r"(?:offers?|provides?|delivers?)\s+(?:a\s+)?(?:better|improved|enhanced|superior)\s+(?:experience|solution|approach)|"
    r"(?:aims?\s+to|designed?\s+to|built?\s+to)\s+(?:provide|offer|deliver|enable|support)|"
    r"(?:helps?\s+to?|enables?\s+to?|allows?\s+to?)\s+(?:users?|teams?|developers?)\s+(?:to\s+)?(?:easily|quickly|efficiently|seamlessly))\b"
)
HEDGED_CAUSE = (
    r"\b(?:because|since|so|therefore|thus)\s+"
    r"(?:(?:it|this|that)\s+)?"
    r"(?:may|might|could|can|would|should)\s+"
    r"(?:potentially|possibly|perhaps|likely|somewhat)\s+"
    r"(?:be|help|improve|provide|enable|support|result)"
)

#: Identifiers that say nothing about a code base.
COMMON_IDENTIFIERS = [
    "this", "that", "from", "with", "have", "been", "were", "will", "would", "could", "should", "because", "which", "their", "there", "about", "after", "before",
    "between", "through", "during",
]

#: domain -> (score of a specific claim, share of the confidence that a claim keeps without specifics); "general" holds for all others.
THRESHOLDS = {
    "code_review": (0.6, 0.35), "docs": (0.4, 0.50), "hiring": (0.4, 0.40), "communications": (0.25, 0.50), "content": (0.4, 0.40), "academia": (0.7, 0.35),
    "marketplace": (0.4, 0.40), "social_news": (0.35, 0.40), "general": (0.4, 0.40),
}

SUGGEST_SPECIFICS = "Add specifics — numbers, filenames, or tool output to strengthen this claim."
SUGGEST_DETAILS = "Consider adding measurable details — benchmarks, metrics, or concrete examples."
SUGGEST_MEASUREMENT = "Add measurement — "
SUGGEST_HOW = "Add measurement — how? Under what conditions?"

#: Frequencies of letter triples in generated text.
SLOP_TRIGRAMS = {
    " th": 0.035, "the": 0.034, "he ": 0.024, "ing": 0.021, " in": 0.020,
    "nd ": 0.018, "ion": 0.018, "and": 0.017, " an": 0.017, "tion": 0.016,
    "tio": 0.016, " of": 0.015, "of ": 0.014, "is ": 0.013, " is": 0.013,
    "ent": 0.012, " to": 0.012, "to ": 0.012, "er ": 0.012, "on ": 0.011,
    " co": 0.011, "es ": 0.011, "ed ": 0.011, "tha": 0.010, "hat": 0.010,
    "at ": 0.010, "or ": 0.010, "re ": 0.010, " re": 0.010, " pr": 0.009,
    "nt ": 0.009, "an ": 0.009, " a ": 0.009, " fo": 0.009, "for": 0.009,
    " it": 0.008, " en": 0.008, "al ": 0.008, "ati": 0.008, " wi": 0.008,
    "wit": 0.008, "ith": 0.008, "th ": 0.008, " ha": 0.008, "ive": 0.007,
    "ver": 0.007, " su": 0.007, "pro": 0.007, "con": 0.007, "com": 0.007,
    "ity": 0.007, "ty ": 0.007, "ess": 0.007, " be": 0.007, " ca": 0.006,
    "ons": 0.006, " as": 0.006, "as ": 0.006, "men": 0.006, " st": 0.006,
}

#: Words of four letters and more that are no entity of a sentence.
NO_ENTITIES = (
    "this that these those they them their there which what when where who how why the and but for not are was were been being have has had does did will would could "
    "should may might must shall can need dare ought used from into like near onto over some than through to toward until upon with within about above below between "
    "under again further once here also very just only even still own same so than too most other each few more both such because while although though since unless "
    "until whether however therefore thus hence then else otherwise meanwhile"
).split()

#: Sentences of our own that touch the patterns above; queries append them to documents, whose prose is invented.
SAMPLES = [
    "We capped retries at 3 because profiling showed 340ms spent in auth/session.py. The old limit doubled charges, which the billing service logged on line 47.",
    "Updated the parser because it was slow and messy. Could this be simpler, or is there a reason? If the cache is cold then reads wait.",
    "Switched from moment.js to date-fns — the bundle analysis put moment at 67kb; before the change builds took 42 seconds. It is better than a shim, given that tests pass.",
    "The rollout waits, since it could potentially help some users in many cases. Therefore the upside is small, and the downside, I fear, is lock contention; hence we wait.",
    "They say that means nothing. The build is the build because the build was built; changed config to fix config, due to various issues that per Code Review came up last week.",
]
