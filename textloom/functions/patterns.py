"""Patterns of the commitment, counterfactual, editing and domain signals. All match without case unless stated."""

# Results depend on exactly these words and patterns.
HEDGE_WORDS = (
    "may might could can would should possibly perhaps potentially likely unlikely probably sometimes often "
    "generally typically usually somewhat relatively fairly rather quite mostly largely mainly primarily"
).split()
HEDGE_PHRASES = [
    r"\bin some cases\b", r"\bdepending on\b", r"\bit depends\b", r"\byour mileage may vary\b", r"\bymmv\b",
    r"\bconsult (?:an? )?(?:expert|professional|specialist)\b", r"\bseek (?:professional )?(?:advice|guidance|help)\b",
    r"\bmay (?:or may )?not\b", r"\bcould (?:or could )?not\b", r"\bmight (?:or might )?not\b",
    r"\bin certain (?:cases|scenarios|situations|conditions)\b", r"\bunder certain (?:circumstances|conditions)\b",
    r"\bthis (?:may|might|could) (?:vary|differ|change)\b", r"\bresults may vary\b", r"\bnot (?:always|necessarily)\b",
    r"\bthere(?:'s| is) no (?:one[- ]size[- ]fits[- ]all|silver bullet|magic bullet)\b",
]
FALSE_BALANCE = [
    r"(?s)\bon (?:the )?one hand\b.{10,300}\bon (?:the )?other hand\b", r"\bpros and cons\b", r"\badvantages and disadvantages\b",
    r"\bbenefits and drawbacks\b", r"\bupsides and downsides\b",
    r"(?s)\bsome (?:people|experts|developers|users) (?:say|think|believe|argue)\b.{10,200}\b(?:others|however|but)\b",
]
RESOLUTION = [
    r"\b(?:therefore|thus|hence|so|consequently),? (?:I|we) (?:recommend|suggest|advise|prefer|choose)\b",
    r"\b(?:my|our) (?:recommendation|suggestion|advice|preference) is\b", r"\b(?:you|we) should (?:use|choose|prefer|go with|pick)\b",
    r"\b(?:don't|do not|avoid|never) (?:use|do|try)\b", r"\bthe (?:best|better|right|correct) (?:approach|choice|option|solution) is\b",
]
OPINION_LAUNDERING = [
    r"\bsome (?:people|experts|developers|users|researchers|studies) (?:say|think|believe|argue|suggest|claim)\b",
    r"\bmany (?:people|experts|developers|users|researchers|studies) (?:say|think|believe|argue|suggest|claim)\b",
    r"\bit is (?:generally|widely|commonly|often) (?:accepted|believed|thought|considered|known)\b",
    r"\bthere is (?:a )?(?:general )?(?:consensus|agreement) that\b", r"\bmost (?:people|experts|developers|users) (?:agree|believe|think)\b",
    r"\bthe (?:general|common|prevailing) (?:consensus|opinion|view|belief) is\b", r"\bit has been (?:said|suggested|argued|claimed) that\b",
    r"\baccording to (?:some|many|most) (?:sources|experts|studies)\b",
]
COMMITMENT = [
    r"\b(?:I|we) (?:recommend|suggest|advise|prefer|choose|decided|chose)\b", r"\byou should (?:use|do|try|avoid|never|switch|migrate|pick|go with)\b",
    r"\b(?:don't|do not|never|stop) (?:use|do|try|rely on|depend on)\b", r"\balways (?:use|do|check|verify|test|prefer|choose)\b",
    r"\buse .{3,60} instead\b", r"\bswitch to\b", r"\bmigrate (?:to|away from)\b", r"\breplace .{3,60} with\b",
    r"\bthis (?:is|will|does) (?:the )?(?:best|better|right|correct|wrong|incorrect)\b", r"\bthe (?:only|best|right|correct) (?:way|approach|solution|method) (?:is|to)\b",
    r"\b(?:this|that) (?:will|won't|does|doesn't) work (?:because|when|if)\b", r"\bthis (?:is|was) (?:a )?(?:mistake|error|wrong|bad idea|poor choice|anti-?pattern)\b",
    r"\bthis will (?:cause|result in|lead to|produce|increase|decrease|break)\b", r"\bcaused (?:a )?\d+", r"\bexhausted at \d+", r"\b\d+x (?:increase|decrease|slower|faster)\b",
    r"\bexpect .{5,50} to (?:increase|decrease|improve|degrade|fail)\b", r"\b(?:avoid|never use|don't use|do not use) .{3,60} because\b",
    r"\binstead[,—] (?:use|do|try|go with)\b", r"\b(?:it's|it is) (?:more|less) .{3,40} but\b", r"\bwe tried .{3,60} and it\b",
    r"\bthe (?:connection|thread|memory|request) (?:pool|limit|budget) (?:exhausted|saturated|maxed)\b",
]
DEFLECTION = [
    r"\bit depends\b", r"\byour mileage may vary\b", r"\bymmv\b", r"\bconsult (?:an? )?(?:expert|professional|specialist)\b",
    r"\bseek (?:professional )?(?:advice|guidance)\b", r"\bthere(?:'s| is) no (?:one[- ]size[- ]fits[- ]all|silver bullet)\b", r"\bresults may vary\b",
]
TECHNICAL_WORDS = (
    "implemented added updated changed fixed refactored deployed migrated configured optimized improved "
    "caching database api service endpoint authentication performance scalability architecture infrastructure"
).split()
REJECTED_ALTERNATIVES = [
    r"\bconsidered .{5,80} but\b", r"\binstead of .{5,80} because\b", r"\b(?:we|I) tried .{5,80} (?:and it|but it) (?:failed|didn't work|broke)\b",
    r"\brejected .{5,80} (?:because|due to|since)\b", r"\brejected (?:it|that|this|them) because\b", r"\b(?:initially|originally|first) (?:tried|used|implemented) .{5,80} but\b",
    r"\breplacing .{5,80} with .{5,80} because\b", r"\bswitching from .{5,80} to .{5,80} (?:because|since|as)\b", r"\bmigrating (?:away )?from .{5,80} (?:because|due to|since)\b",
    r"\b(?:chose|picked|selected) .{5,80} over .{5,80} (?:because|since)\b", r"\balternative(?:s)? (?:considered|evaluated|explored)[:\s]",
    r"\bother options? (?:considered|evaluated|explored)[:\s]", r"\bwent with .{3,40} (?:over|instead of|rather than)\b", r"\b\w+ over \w+ because\b",
]
FAILURE_MODES = [
    r"\bthis (?:breaks|fails|doesn't work|won't work) (?:when|if|under)\b", r"\bedge case(?:s)?[:\s]", r"\bcaveat(?:s)?[:\s]", r"\blimitation(?:s)?[:\s]",
    r"\bknown (?:issue|bug|problem|limitation|risk)(?:s)?[:\s]", r"\b(?:doesn't|does not|won't|will not|can't|cannot) (?:handle|support|work with|invalidate|scale)\b",
    r"\b(?:will|would) fail (?:if|when|under)\b", r"\b(?:breaks|fails) (?:when|if) .{5,80} (?:exceeds|reaches|drops below)\b", r"\bnot (?:thread[- ]safe|reentrant|idempotent)\b",
    r"\b(?:race condition|deadlock|memory leak) (?:when|if|under)\b", r"\b(?:assumes|requires|expects) .{5,80} (?:to be|is|are)\b", r"\bwhat (?:could|can) go wrong[:\s]",
    r"\bfailure (?:mode|scenario|case)(?:s)?[:\s]", r"\b(?:this|that) (?:will|would) (?:break|fail) (?:if|when)\b", r"\b(?:risks?|risk of) (?:showing|causing|creating|introducing)\b",
    r"\b(?:hammer|saturate|exhaust|overwhelm) (?:the )?\w+\b", r"\b(?:cache miss storm|thundering herd|connection exhaustion)\b", r"\baccepted (?:that |this )?risk\b",
    r"\bstale (?:data|cache|results?)\b", r"\b(?:pool|queue|buffer) (?:exhausted|saturated|full|overflow)\b",
]
SPECIFIC_CONDITIONS = [
    r"\bonly works (?:if|when|under)\b", r"\brequires (?:that|the) .{5,80} (?:to be|is|are)\b", r"\bassumes .{5,80} (?:is|are|to be)\b", r"\bprecondition(?:s)?:\b",
    r"\bpostcondition(?:s)?:\b", r"\binvariant(?:s)?:\b", r"\b(?:must|need to|have to) (?:ensure|verify|check) (?:that)?\b",
    r"\b(?:if|when) .{5,80} (?:then|,) .{5,80} (?:will|won't|must|can't)\b", r"\bdepends on .{5,80} being\b", r"\b(?:won't|will not) work (?:if|when|unless)\b",
]
SPECIFIC_TRADEOFFS = [
    r"\btrade[- ]?off[:\s]", r"\btrading .{5,80} for .{5,80}\b", r"\bsacrificing .{5,80} (?:for|to (?:gain|get))\b", r"\b(?:faster|slower|larger|smaller|more|less) .{5,80} but .{5,80}\b",
    r"\b(?:increases|decreases|improves|degrades) .{5,80} (?:at the cost of|but reduces|but increases)\b", r"\bthe (?:downside|upside|cost|tradeoff) is .{5,80}\b",
    r"(?s)\b(?:pros|benefits):.{10,200}(?:cons|drawbacks|costs):\b", r"\b(?:advantage|benefit):.{5,80}(?:disadvantage|drawback|cost):\b",
    r"\b(?:shorter|lower|smaller|fewer) (?:would|will|could) .{5,60}(?:,|;) (?:longer|higher|larger|more) (?:risks?|would|will)\b",
    r"\b(?:it's|it is) (?:more|less) .{3,40} but (?:the|it|we)\b", r"\bmore verbose but\b", r"\bmore (?:complex|complicated|expensive|costly) but\b",
    r"\baccepted (?:that |this )?risk\b", r"\bat the (?:cost|expense|price) of\b",
]
GENERIC_COUNTERFACTUALS = [
    r"\bmay (?:have|cause) performance (?:implications|issues|problems)\b", r"\bcould (?:potentially )?(?:impact|affect) (?:performance|scalability|reliability)\b",
    r"\bmight not scale\b", r"\bmay not work in all (?:cases|scenarios|situations)\b", r"\b(?:some|certain) (?:edge cases|scenarios|situations) (?:may|might|could)\b",
    r"\bresults may vary\b", r"\byour mileage may vary\b", r"\bdepending on (?:your|the) (?:use case|requirements|needs)\b",
]
#: (a claim, what excuses it within 100 characters)
BEST_PRACTICE = [
    (r"\bbest practice(?:s)?\b", "when|if|unless|except|but|however"), (r"\b(?:always|never) (?:use|do|avoid)\b", "unless|except|when|if"),
    (r"\byou should (?:always|never)\b", "unless|except|when|if"),
]
COMPLEXITY = (
    "architecture design implementation algorithm optimization performance scalability security authentication authorization "
    "distributed concurrent parallel async threading locking caching database migration deployment infrastructure"
).split()
NEGATIVE = [
    "but", "however", "although", "caveat", "limitation", "edge case", "fails", "breaks", "doesn't", "won't", "can't", "issue", "problem",
    "tradeoff", "cost", "downside", "risk", "concern",
]
EDITING = [
    r"\bactually\b", r"\bwait\b", r"\bcorrection:", r"\bedit:", r"\bupdate:", r"\bstrikethrough\b", r"\boops\b", r"\btypo\b", r"\bnvm\b", r"\bnevermind\b",
    r"\bscratch that\b", r"\bon second thought\b", r"~~.+~~",
]
REVISION = [r"\boriginally\b", r"\bchanged from\b", r"\bwas\s+\w+\s+now\b", r"\brevision\b", r"\bv\d+", r"\bdraft\b", r"\bpreviously\b", r"\bupdated to\b"]
UNCERTAINTY = [
    r"\bi think\b", r"\bprobably\b", r"\bnot sure if\b", r"\bmight need to\b", r"\bmaybe\b", r"\bi guess\b", r"\bi feel like\b", r"\bnot certain\b", r"\bcould be wrong\b",
    r"\bif i recall\b", r"\biirc\b", r"\bafaik\b", r"\bimo\b", r"\bimho\b",
]
DISAGREEMENT = [
    r"\bbut\b", r"\bhowever\b", r"\balthough\b", r"\bon the other hand\b", r"\bcounterpoint\b", r"\bthat said\b", r"\bnevertheless\b", r"\bnonetheless\b", r"\bstill,\b",
    r"\beven so\b", r"\bi disagree\b", r"\bnot really\b",
]
CONTRACTION = r"\b\w+'(?:t|s|re|ve|ll|d|m)\b"
FIRST_PERSON = r"\b(?:I|me|my|myself|we|us|our)\b"  # with case
NAME_PAIR = r"\b[A-Z][a-zA-Z]{2,}\s+[A-Z][a-zA-Z]{2,}\b"  # with case
DIRECT_REFERENCE = r"\b(?:I|we)\s+(?:saw|found|noticed|observed|tested|verified|measured|discovered|confirmed)\b"
CURVE_FILLER = [
    "best practices", "user experience", "robust", "seamless", "leverage", "cutting-edge", "comprehensive", "enhance", "it is generally accepted", "results may vary",
    "your mileage may vary", "depending on your use case", "in today's", "going forward", "paradigm", "holistic",
]

#: Sentences of our own that touch the lists above; queries append them to documents, whose prose is invented.
SAMPLES = [
    "We considered a queue in front of the database but rejected it because retries would hammer the pool. I recommend the batch job, and this fails when the disk is full.",
    "On the one hand the cache is fast, on the other hand it is stale at times. It depends, and results may vary; you may or may not need it.",
    "Many experts believe that best practices improve performance and security. It is widely accepted, and it could potentially affect scalability.",
    "Edit: I think the draft was wrong, but we measured it in New York and it's fine now! Originally we had v2, which Maria Lopez changed.",
    "Never use the old endpoint because this will break the migration, unless the deployment is small.",
    "The algorithm trades memory for time, and the downside is a longer warm-up. Perhaps it would rather be slower but safer.",
    "There is no silver bullet. Some people say it works, however others do not. Therefore we recommend the simple way.",
]
