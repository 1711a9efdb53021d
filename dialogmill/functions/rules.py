"""Rule tables. The values below are fixed: results depend on these very patterns, phrases, labels and numbers."""

# Patterns are written in the common part of Java's and RE2's dialects. W is a word character, B a word boundary of Unicode text.
W = r"[\p{L}\p{N}_]"
B = r"\b"

# ---- corpus cleaning: (pattern, replacement), in order ----
CONTROL = [(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"\r\n|\r", "\n"), (r"[ \t]+", " "), (r"\n{4,}", "\n\n\n")]
CHUNK_NORMAL = [(r"\r\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")]
HTML_TAGS = [(r"<[^>]+>", " "), (r"&[a-z]+;", " ")]
HTML_DROPPED = ["script", "style", "nav", "footer", "header"]
HTML_ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
MARKDOWN = [
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,3}(.+?)\*{1,3}", r"\1"),
    (r"`{1,3}[^`]*`{1,3}", ""),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"\[(.+?)\]\(.*?\)", r"\1"),
    (r"(?m)^[-*+]\s+", ""),
    (r"(?m)^[0-9]+\.\s+", ""),
]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
INSTRUCTION = [(r"<[^>]+>", ""), (r"\n{3,}", "\n\n"), (r" {2,}", " "), (EMAIL, "[EMAIL]")]

# ---- scoring ----
ROLE_LEAK = r"(?i)\b(user:|assistant:|system:)\b"
WEIGHTS = {"accuracy": 0.40, "relevance": 0.35, "coherence": 0.25}
GRADES = [(0.85, "A", "Excellent"), (0.70, "B", "Good"), (0.55, "C", "Acceptable"), (0.40, "D", "Poor"), (0.0, "F", "Failing")]
BAD_BELOW = 0.55
REASONS = {
    "empty": "Empty response",
    "accuracy": "Low factual accuracy — key facts missing from response",
    "relevance": "Off-topic — response has low semantic similarity to the prompt",
    "coherence": "Incoherent — response is repetitive, too short, or structurally broken",
    "leak": "Role leakage — model hallucinated conversational role markers",
    "short": "Truncated — response is fewer than 5 words",
    "other": "Composite score below threshold",
}
USER_REASON = "User reported 👎 thumbs-down"

# ---- intents ----
CODE_SIGNATURES = [
    r"\bdef \w+\(", r"\bclass \w+:", r"\bimport \w+", r"\bfunction\s*\(?", r"\bconst \w+\s*=", r"=>", r"\bpublic static void", r"\bSystem\.out",
    r"#include\s*<", r"\bstd::", r"SELECT .* FROM", r"UPDATE .* SET",
]
INTENTS = [
    (r"\b(hello|hi|hey|good morning|good evening|howdy|greetings|sup|yo)\b", "greeting"),
    (r"\b(debug|fix the bug|traceback|stack trace|exception|why is this failing|not working as expected|diagnose|runtime error|syntax error)\b", "debugging"),
    (r"\b(brainstorm|ideas for|come up with|suggest ideas|think of|what are some ways|alternatives|possibilities|generate ideas|creative ideas)\b", "brainstorming"),
    (r"\b(how to|steps to|guide|tutorial|explain|walk me through|steps for|procedure)\b", "instruction"),
    (r"\b(write|code|implement|function|class|script|python|javascript|java|cpp|c#|html|css)\b", "coding"),
    (r"\b(calculate|solve|equation|math|integral|derivative|sum of|probability|maths|formula)\b", "math"),
    (r"\b(what is|who is|when did|where is|define|meaning of|tell me about|details on|info on|fact check|history of)\b", "factual"),
    (r"\b(should i|do you think|opinion|better|worse|recommend|suggest)\b", "opinion"),
    (r"\b(clarify|what do you mean|can you explain|elaborate|more detail)\b", "clarification"),
    (r"\b(not working|broken|wrong|incorrect|bad|terrible|frustrated|annoyed)\b", "complaint"),
]
CODING = {
    "direct_solution": [
        r"\b(complete the function|give (me )?(the )?solution|solve this|write code for|implement this)\b", r"\b(hackerrank|leetcode|codeforces|codewars)\b",
        r"(sample input|sample output|constraints:)", r"\b(write a program|return the result)\b",
    ],
    "debugging": [r"\b(fix this( code)?|bug|error|exception|not working|traceback|why is this failing|diagnose)\b", r"\b(syntax error|runtime error|logic error)\b"],
    "explanation": [r"\b(explain this code|how does this work|walk me through|what does this do)\b", r"\b(step by step explanation)\b"],
    "optimization": [
        r"\b(optimize|make it faster|time complexity|space complexity|improve performance|reduce memory|more efficient)\b", r"\b(o\(n\)|o\(1\)|o\(log n\)|o\(n\^2\))\b",
    ],
    "conversion": [r"\b(convert this to|translate this to|rewrite in|port to)\b", r"\b(from python to|from java to|from cpp to|from javascript to)\b"],
    "algorithm": [
        r"\b(how does (the )?algorithm work|explain (the )?algorithm|concept behind|theory behind)\b", r"\b(bfs|dfs|dynamic programming|greedy|backtracking|divide and conquer)\b",
    ],
}
SNIPPET = r"(def \w+\(.*pass\b|\btodo\b|\.\.\.)"
CHALLENGE = r"(leetcode|hackerrank|constraints:|sample input|sample output)"
SIMPLE_INTENTS = [
    ("greeting", ["hi", "hello", "hey", "greetings"]),
    ("coding", ["code", "python", "script", "function", "bug", "fix"]),
    ("factual", ["what", "who", "when", "where", "fact", "define"]),
    ("opinion", ["think", "opinion", "recommend", "should"]),
]
MAX_SENTENCES = {"greeting": 1, "factual": 3, "coding": 10, "opinion": 4, "general": 3}
RETRIEVAL_INTENTS = ["factual", "coding", "math", "instruction", "general", "clarification", "debugging", "brainstorming"]
LANGUAGES = [
    ("javascript", r"(?m)^(const|let|var|function|import|export|console\.log)\b"),
    ("python", r"(?m)^(def|class|import|from|print|if __name__|elif|yield)\b"),
    ("java", r"(?m)^(public|private|protected|class|interface|static|void|System\.out)\b"),
    ("cpp", r"(?m)^(#include|using namespace|int main|std::|cout)\b"),
    ("html", r"<\/?(html|body|div|span|p|a|script|style)[^>]*>"),
    ("css", r"([.#\w][^{]+)\{([^}]+)\}"),
    ("sql", r"(?i)^(SELECT|UPDATE|DELETE|INSERT|CREATE|DROP|ALTER)\b"),
]
STEPS = {
    "factual": ["Recall relevant facts and definitions.", "Cross-check for potential ambiguity in the question.", "Provide a clear, direct answer with supporting context."],
    "coding:direct_solution": [
        "Identify this as a coding challenge and lock into CODE SOLVER MODE.",
        "Provide a short approach explanation (2–4 lines maximum).",
        "Write the complete, final working code.",
        "Provide Time Complexity.",
        "Provide Space Complexity.",
        "Strictly follow the MANDATORY RESPONSE FORMAT structure: Approach -> Code -> Time Complexity -> Space Complexity.",
    ],
    "coding:debugging": [
        "Identify the root cause of the error or unexpected behavior.",
        "Explain why it happens in plain terms.",
        "Provide a concrete fix with corrected code if applicable.",
        "Mention how to avoid the issue in the future.",
    ],
    "coding:explanation": [
        "Break down the provided code step by step.",
        "Explain what each part does and how it contributes to the overall logic.",
        "Avoid rewriting the code unless a simplification helps understanding.",
    ],
    "coding:optimization": [
        "Analyze the current time and space complexity.",
        "Identify bottlenecks in the code.",
        "Provide an optimized version with improved complexity.",
        "Explain the improvements clearly.",
    ],
    "coding:conversion": [
        "Identify the source language and the target language.",
        "Translate the logic idiomatically to the target language.",
        "Note any language-specific differences or caveats.",
    ],
    "coding:algorithm": [
        "Explain the theoretical concept behind the algorithm.",
        "Walk through an example of how it works.",
        "Discuss its typical use cases and complexities.",
    ],
    "coding": [
        "Understand the programming task and language constraints.",
        "Plan the solution approach (algorithm / data structure).",
        "Write clean, commented code.",
        "Add usage examples or edge-case notes.",
    ],
    "math": [
        "Identify the mathematical concept and required operations.",
        "Lay out the step-by-step solution method.",
        "Compute and verify the result.",
        "Explain the reasoning so the user can learn from it.",
    ],
    "instruction": [
        "Break the task into ordered, actionable steps.",
        "Highlight prerequisites or caveats up front.",
        "Provide each step with enough detail to follow independently.",
    ],
    "opinion": [
        "Acknowledge this is a subjective or preference-based question.",
        "Present balanced perspectives where applicable.",
        "Offer a concrete recommendation with clear reasoning.",
    ],
    "clarification": [
        "Identify which part of the previous response was unclear.",
        "Rephrase the explanation using simpler language or an analogy.",
        "Invite follow-up if still unclear.",
    ],
    "complaint": [
        "Acknowledge the user's frustration empathetically.",
        "Diagnose what went wrong without being defensive.",
        "Propose a clear corrective action or alternative.",
    ],
    "debugging": [
        "Identify the root cause of the error or unexpected behavior.",
        "Explain why it happens in plain terms.",
        "Provide a concrete fix with corrected code if applicable.",
        "Mention how to avoid the issue in the future.",
    ],
    "brainstorming": [
        "Generate a range of distinct, creative ideas relevant to the topic.",
        "Keep each idea concise — a sentence or two max.",
        "Prioritize variety and usefulness over quantity.",
    ],
    "greeting": ["Respond naturally and personably in one short sentence.", "Do NOT offer a numbered list of options or ask how to assist in a robotic way."],
    "general": ["Understand the core of the user's request.", "Provide a helpful, well-structured response.", "Offer to elaborate or clarify if needed."],
}

# ---- responses ----
ROBOTIC = [
    (r"(?i)As an AI(?: assistant|language model)?[,.]?\s*", ""),
    (r"(?i)I would be delighted to[,.]?\s*", ""),
    (r"(?i)How may I assist your[^?]*\??\s*", ""),
    (r"(?i)Certainly(?:! Here are several options\.\.\.|[,!])\s*", ""),
    (r"(?i)Based on your query[,.]?\s*", ""),
    (r"(?i)Of course[,!]\s*", ""),
    (r"(?i)Absolutely[,!]\s*", ""),
    (r"(?i)Great question[,!]\s*", ""),
    (r"(?i)Here is the code:?\s*", ""),
    (r"(?i)Let's understand .*? first\s*", ""),
]
LEAKS = [(r"(?i)\buser:\s*", ""), (r"(?i)\bassistant:\s*", ""), (r"(?i)\bsystem:\s*", "")]
OPENERS = [
    (r"(?i)^(The answer is:?)", "Here's the answer:"),
    (r"(?i)^(No\.?\s)", "I'm sorry, but no. "),
    (r"(?i)^(Yes\.?\s)", "Yes — "),
    (r"(?i)^(I don't know\.?)", "I'm not entirely sure, but I can try to help."),
    (r"(?i)^(Okay\.?\s)", "Sure — "),
]
COMPLAINT_HEADER = "I understand this isn't working as expected — let's fix it. "
SPACING = [(r"\n{3,}", "\n\n"), (r" {2,}", " ")]
TONE = [
    (r"(?i)As an AI(?: language model)?[,.]?\s*", ""),
    (r"(?i)I am an AI[,.]?\s*", ""),
    (r"(?i)I can certainly help with that[!.]?\s*", ""),
    (r"(?i)Here is the information you requested:?\s*", ""),
    (r"(?i)Let me know if you need anything else[!.]?\s*", ""),
    (r"(?i)I hope this helps[!.]?\s*", ""),
    (r"(?i)Feel free to ask if you have more questions[!.]?\s*", ""),
    (r"(?i)Certainly[!.]?\s*", ""),
    (r"(?i)Of course[!.]?\s*", ""),
    (r"(?i)Absolutely[!.]?\s*", ""),
]
STOP_TOKENS = ["<|im_start|>", "<|im_end|>", "<|user|>", "<|assistant|>", "<|system|>", "</s>", "\nuser:", "\nassistant:", "\nsystem:"]
MIN_WORDS = 8

# ---- memory ----
KEY_INFO = [
    ("name", r"(?i)\bmy name is ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"),
    ("name", r"(?i)\bcall me ([A-Z][a-z]+)"),
    ("location", r"(?i)\bI(?:'m| am) (?:from|in|at|based in) ([\w\s,]+?)(?:\.|,|$)"),
    ("language", r"(?i)\bI(?:'m| am) (?:learning|using|coding in) ([\w+#]+)"),
    ("preference", r"(?i)\bI (?:prefer|like|love|hate|dislike|want) ([\w\s]+?)(?:\.|,|$)"),
    ("goal", r"(?i)\bI(?:'m| am) (?:trying|working|building|creating|making) ([\w\s]+?)(?:\.|,|$)"),
    ("context", r"(?i)\bmy (?:project|app|system|bot|model) (?:is|uses) ([\w\s]+?)(?:\.|,|$)"),
]

# ---- retrieval, training data ----
CONTEXT_HEAD = "### Retrieved Knowledge\n"
CONTEXT_TAIL = (
    "Use the retrieved knowledge above to inform your answer where relevant. If the context does not address the question, use your general knowledge. "
    "Do not fabricate information that contradicts the context."
)
SYSTEM_PROMPTS = [
    "You are a helpful and polite AI assistant.",
    "You are an expert customer support bot.",
    "You are an AI trained to provide concise, accurate answers.",
]
ASSISTANT_MARK = "\n\nAssistant: "

# ---- fixed phrases of summaries, checks and prompts; {} stands for a value ----
RUNAWAY = "Runaway generation — response is {} words (> 500)"
INTENT_SUMMARY = {
    "upgraded": "User is asking a question or requesting a fix for the provided code.",
    "named": "User is making a {} request.",
    "code": "User provided a raw code snippet. They likely want it reviewed or explained.",
    "general": "User is making a general request.",
}
ISSUES = {
    "short": "Response too short ({} words, min 8).",
    "leak": "Role-leakage tokens detected (user:/assistant:/system:).",
    "repetition": "High repetition detected (unique-word ratio: {}).",
    "ending": "No sentence-ending punctuation found.",
    "no_block": "Coding response missing code block (```).",
    "open_block": "Markdown code block is not properly closed.",
    "braces": "Unclosed braces detected in code.",
}
RECOVERY = {
    "head": "[SYSTEM RECOVERY]: The previous generation was interrupted or incomplete. ",
    "mode": "Maintain CODE SOLVER MODE. Do NOT restart reasoning or explanation.",
    "line": "Resume exactly from the last complete line: `{}`.",
    "where": "Resume code generation exactly where it left off.",
    "block": "Ensure the markdown code block (```) is properly closed.",
    "braces": "Ensure {} pending open braces ({) are closed.",
    "python": "Maintain proper Python indentation for the incomplete block.",
    "end": "Complete the final code immediately.",
    "plain": "Please seamlessly continue the previous response without apologizing.",
}
