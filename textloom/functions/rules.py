"""Fixed tables that the operators follow: keywords, stop words, synonyms, fact templates, command filters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Keywords of the topics of memory facts.
RULE_TOPICS = {
    "coding": ["code", "function", "compile", "error", "bug"],
    "project": ["project", "build", "architecture", "feature"],
    "preferences": ["name", "prefer", "always", "never"],
}

# Keywords of the topics of prompt sections.
SECTION_TOPICS = {
    "coding": ["code", "function", "class", "variable", "syntax", "programming"],
    "safety": ["safe", "harm", "dangerous", "inappropriate", "refuse"],
    "formatting": ["format", "markdown", "bullet", "list", "header"],
    "math": ["calculate", "equation", "formula", "mathematical"],
    "creative_writing": ["write", "story", "creative", "fiction", "poem"],
    "data_analysis": ["table", "dataset", "csv", "analysis", "statistics"],
    "conversation": ["tone", "friendly", "conversation", "personality", "style"],
    "python": ["python", "pandas", "numpy", "py"],
    "javascript": ["javascript", "typescript", "node", "react"],
}

# Section name patterns that each query topic asks for.
TOPIC_SECTIONS = {
    "coding": ["code_formatting", "programming_*", "technical_*"],
    "python": ["code_formatting", "python_*", "programming_*"],
    "javascript": ["code_formatting", "javascript_*", "web_*"],
    "math": ["math_*", "formatting_numbers", "latex_*"],
    "creative_writing": ["creative_*", "writing_style", "tone_*"],
    "data_analysis": ["data_*", "tables", "charts", "csv_*"],
    "conversation": ["tone_*", "personality", "response_style"],
    "safety": ["safety_*", "refusal_*", "harmful_*"],
}

# Cues of section priorities 0, 1 and 2 in the section's name and content.
PRIORITIES = [
    (0, ["core", "identity", "safety"], ["you are", "you must", "must not", "never"]),
    (1, ["policy"], ["important", "policy", "required"]),
    (2, ["format"], ["style", "format", "guideline"]),
]

# Capitalised words that name nothing, in texts.
ENTITY_STOP = ["The", "This", "That", "These", "Those", "What", "When", "Where", "Which", "Who", "Whom", "Whose", "How", "Why", "Yes", "No", "Not", "But", "And", "Or", "For", "Are", "Was", "Were", "Has", "Have", "Had", "Will", "Would", "Could", "Should", "May", "Can", "Did", "Does", "Been", "Being", "Also", "Just", "Very", "Really", "Some", "Any", "All", "Each", "Every", "Most", "More", "Much", "Many", "Other", "Another", "Here", "There", "Then", "Now", "Well", "Too", "Sure", "Nice", "Good", "Great", "Cool", "Thanks", "Sorry", "Please", "Hello", "Hi", "Okay", "OK", "Mr", "Mrs", "Ms", "Dr", "If", "It", "Is", "As", "At", "In", "On", "To", "By", "Of", "Be", "Do", "So", "Session", "User", "Assistant", "System"]

# The same in hits that a query is widened with.
HIT_STOP = ["The", "This", "That", "These", "Those", "What", "When", "Where", "Which", "Who", "How", "Why", "Yes", "Not", "But", "And", "For", "Are", "Was", "Were", "Has", "Have", "Had", "Will", "Would", "Could", "Should", "May", "Can", "Did", "Does", "Been", "Being", "Also", "Just", "Very", "Really", "Some", "Any", "All", "Each", "Every", "Most", "More", "Much", "Many", "Other", "Another", "Here", "There", "Then", "Now", "Well", "Too", "Sure", "Nice", "Good", "Great", "Cool", "Thanks", "Sorry", "Please", "Hello"]

# The same in questions.
ASKING_STOP = ["What", "When", "Where", "Which", "Who", "Whom", "Whose", "How", "Why", "Did", "Do", "Does", "Is", "Are", "Was", "Were", "Has", "Have", "Had", "Can", "Could", "Will", "Would", "Should", "May", "Might", "Shall", "The", "This", "That", "These", "Those", "A", "An", "And", "Or", "But", "If", "Then", "So", "On", "In", "At", "For", "With", "To", "From", "By", "Of"]

# What a question to the graph leaves out besides.
GRAPH_STOP = [*ASKING_STOP, "Session", "User", "Assistant"]

# Words that join nothing with and.
FILLERS = ["yes", "no", "ok", "sure", "maybe", "please", "also", "too"]

# Categories, patterns and wording of facts in user turns; {0} is the match, {1} its first group.
FACTS = [
    ("user_identity", r"(?i)my name is ([A-Za-z][\w\s-]{0,40})", "User's name is {1}"),
    ("user_identity", r"(?i)i(?:'m| am) (?:a |an )?([A-Za-z][\w\s]{1,60})", "User is {1}"),
    ("user_identity", r"(?i)i (?:live|moved|relocated) (?:in|to) ([A-Za-z][\w\s,]{1,60})", "User lives in {1}"),
    ("user_identity", r"(?i)i(?:'m| am) (\d{1,3}) years? old", "User is {1} years old"),
    ("project_context", r"(?i)(?:working on|building|creating|developing|maintaining) (?:a |an |the )?(.+?)(?:\.|,|$)", "Working on: {1}"),
    ("project_context", r"(?i)(?:the|our|my) (?:project|app|service|tool|system) (?:is called|is named|name is) ([A-Za-z][\w\s-]{1,40})", "Project name: {1}"),
    ("technical_decision", r"(?i)(?:using|chose|decided on|going with|switched to|migrated to) ([A-Za-z][\w\s.+-]{1,60})", "Using {1}"),
    ("technical_decision", r"(?i)(?:i |we )prefer ([A-Za-z][\w\s]{1,40})", "Preference: {1}"),
    ("instruction", r"(?i)(?:always|never|please|don't|do not|make sure to) (.+?)(?:\.|!|$)", "Instruction: {0}"),
    ("constraint", r"(?i)(?:deadline|due date|due by|by|on|scheduled for) (?:is )?(\w+ \d{1,2}(?:st|nd|rd|th)?(?:,? \d{4})?)", "Date: {0}"),
    ("user_identity", r"(?i)(?:my |our )(?:friend|colleague|partner|wife|husband|brother|sister|boss|manager|team) ([A-Za-z][\w\s]{1,30})", "Relationship: {0}"),
]

#: Categories of which only the latest statement stays active.
MUTABLE = ["user_identity", "project_context", "technical_decision"]


@dataclass
class Step:
    """One pass over the lines of an output."""

    kind: str  # filter, group, dedup, truncate, columns, json
    remove: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    key: str = ""
    form: str = ""
    least: int = 0
    threshold: float = 1.0
    most: int = 0
    fields: list[str] = field(default_factory=list)
    items: int = 0
    chars: int = 0


@dataclass
class Filter:
    name: str
    commands: list[str]
    steps: list[Step]
    budget: int
    head: int
    tail: int


BLANK = r"^\s*$"


def _filter(remove: list[str], keep: list[str]) -> Step:
    return Step("filter", remove=remove, keep=keep)


def _truncate(most: int, form: str) -> Step:
    return Step("truncate", most=most, form=form)


# Which output filter a command gets (the first that matches) and its steps, budget, head and tail lines.
FILTERS = [
    Filter("git_push_pull", [r"^\s*git\s+(push|pull|fetch)\b"], [_filter([r"^(Enumerating|Counting|Compressing|Writing|Delta|Total)", r"^remote:", r"^Unpacking", r"^Resolving", BLANK], [r"^\s*[a-f0-9]+\.\.[a-f0-9]+", r"->", r"Fast-forward", r"Already up to date", r"error:", r"fatal:", r"Everything up-to-date", r"To "])], 100, 0, 3),
    Filter("git_status", [r"^\s*git\s+status"], [_filter([r'^\s*\(use "git"', r"^On branch", r"^Your branch is", r"^Changes not staged", r"^Changes to be committed", r"^Untracked files:", r"^no changes added to commit", r"^nothing to commit", BLANK], [r"^\s*(modified|deleted|new file|renamed|typechange|both modified):"])], 400, 0, 0),
    Filter("git_log", [r"^\s*git\s+log"], [_filter([r"^Author:", r"^AuthorDate:", r"^Commit:", r"^CommitDate:", r"^Date:", BLANK, r"^    (Signed-off-by|Co-authored-by):"], []), _truncate(40, "... {n} more commits omitted ...")], 600, 10, 0),
    Filter("git_diff", [r"^\s*git\s+diff"], [_filter([r"^index [0-9a-f]+\.\.[0-9a-f]+"], [r"^(diff|---|\+\+\+|@@)", r"^[+-][^+-]"]), Step("dedup", threshold=1.0, form="{line}  // (× {count})"), _truncate(120, "... diff truncated, {n} lines omitted ...")], 1200, 10, 5),
    Filter("cargo_test", [r"^\s*cargo\s+test"], [_filter([r"^test .+ \.\.\. ok$", r"^test .+ \.\.\. ignored", r"^running \d+ tests?$", r"^\s*Running ", r"^\s*Compiling ", r"^\s*Finished ", r"^\s*Doc-tests ", BLANK], [r"FAILED", r"^test .+ \.\.\. FAILED", r"^failures:", r"^---- .+ ----", r"thread .+ panicked", r"^test result:", r"^error", r"^warning", r"^note:", r"assertion"])], 800, 0, 5),
    Filter("pytest", [r"^\s*pytest", r"^\s*python\s+-m\s+pytest"], [_filter([r"^=+ test session starts =+", r"^platform ", r"^plugins:", r"^collected \d+ items", r"^rootdir:", r"\bPASSED\b", r"^\s*\.+\s*$", r"^$"], [r"FAILED", r"ERROR", r"^E\s+", r"^=+ FAILURES =+", r"^=+ ERRORS =+", r"^=+ short test summary", r"^_+ ", r"AssertionError"])], 800, 0, 5),
    Filter("vitest_jest", [r"^\s*vitest", r"^\s*jest", r"^\s*(npm|pnpm|yarn)\s+test"], [_filter([r"^✓", r"^\s+✓", r"^PASS ", BLANK, r"^\s+[\d.]+ms"], [r"^✗", r"^×", r"^FAIL ", r"Error:", r"Expected", r"Received", r"Test Files", r"Tests\s+\d+"])], 800, 0, 5),
    Filter("go_test", [r"^\s*go\s+test"], [_filter([r"^ok\s+", r"^=== RUN", r"^--- PASS:", r"^PASS$", BLANK, r"^\?\s+"], [r"^--- FAIL:", r"^FAIL\s+", r"^FAIL$", r"panic:", r"Error"])], 800, 0, 5),
    Filter("ls_tree", [r"^\s*ls(\s|$)", r"^\s*tree(\s|$)"], [Step("group", key=r"\.([a-zA-Z0-9]{1,10})\s*$", form="*.{key}: {count} files", least=4), _truncate(40, "... {n} more entries ...")], 500, 5, 0),
    Filter("grep", [r"^\s*(grep|rg|ripgrep|ag|ack)\b"], [Step("group", key=r"^([^:]+):\d+", form="{key}: {count} matches", least=5), _truncate(80, "... {n} more matches ...")], 800, 15, 5),
    Filter("find", [r"^\s*find\s"], [Step("group", key=r"^(.+)/[^/]+$", form="{key}/: {count} entries", least=5), _truncate(40, "... {n} more entries ...")], 500, 10, 0),
    Filter("docker_ps", [r"^\s*docker\s+(ps|container\s+ls)", r"^\s*podman\s+(ps|container\s+ls)"], [Step("columns", fields=["NAMES", "STATUS", "PORTS"])], 300, 1, 0),
    Filter("docker_logs", [r"^\s*docker\s+logs", r"^\s*podman\s+logs", r"^\s*kubectl\s+logs"], [Step("dedup", threshold=0.9, form="{line} (x{count})"), _truncate(80, "... {n} log lines omitted ...")], 800, 5, 20),
    Filter("npm_install", [r"^\s*(npm\s+(install|i)\b)", r"^\s*yarn\s+add\b", r"^\s*pnpm\s+(add|install)\b"], [_filter([r"^npm http", r"added \d+ packages?", r"⸩", r"idealTree", BLANK, r"^npm timing", r"^npm sill", r"^npm verb", r"^\.\.\.$"], [r"npm ERR!", r"npm WARN", r"up to date", r"added \d+ packages? in", r"^\d+ packages? are looking for funding"]), Step("dedup", threshold=0.85, form="{line} (x{count})")], 300, 0, 5),
    Filter("pip_install", [r"^\s*pip3?\s+install\b"], [_filter([r"^\s*Downloading\b", r"^\s*Installing collected packages", r"^\s*Using cached\b", r"━", BLANK, r"^\s*Collecting\b", r"^\s*Using legacy", r"^\s*Preparing metadata", r"^\s*Building wheel"], [r"ERROR", r"WARNING", r"Successfully installed", r"Requirement already satisfied", r"Could not"]), Step("dedup", threshold=0.85, form="{line} (x{count})")], 300, 0, 5),
    Filter("terraform_apply", [r"^\s*terraform\s+(apply|plan)\b"], [_filter([BLANK, r"^\s*provider\[", r"^Initializing", r"^Refreshing state", r"^Reading\.\.\.", r"Still reading", r"Read complete", r"^\s+[a-z_]+\s+=", r"^Terraform has been successfully", r"^This plan was saved", r"^Note:"], [r"^\s*[+\-~].*resource\b", r"^Plan:", r"^Apply complete!", r"^Error:", r"^Warning:", r"will be (created|destroyed|updated)", r"must be replaced", r"^Destroy complete!", r"^Changes to Outputs"]), _truncate(60, "... {n} lines of terraform output omitted ...")], 600, 5, 10),
    Filter("kubectl_get", [r"^\s*kubectl\s+get\b"], [Step("json", items=5, chars=200), Step("columns", fields=["NAME", "READY", "STATUS", "AGE"])], 1200, 1, 0),
    Filter("kubectl_describe", [r"^\s*kubectl\s+describe\b"], [_filter([BLANK, r"^\s*Annotations:", r"^\s+kubernetes\.io/", r"^\s+kubectl\.kubernetes\.io/", r"^\s*Managed Fields:", r"^\s+Manager:", r"^\s+Operation:", r"^\s+Time:", r"^\s+API Version:", r"^\s+Fields Type:"], [r"^Name:", r"^Namespace:", r"^Status:", r"^(Ready|Phase|Reason|Type|Message):", r"^Node:", r"^IP:", r"^Conditions:", r"^\s+(True|False|Unknown)\s", r"^Events:", r"Warning", r"Error", r"^Labels:"]), _truncate(60, "... {n} lines of kubectl describe output omitted ...")], 600, 5, 15),
    Filter("curl_verbose", [r"^\s*curl\b.*\s-v(?:\s|$)", r"^\s*curl\b.*\s--verbose\b", r"^\s*curl\b.*\s--trace(?:-ascii|-ids|-time)?\b"], [_filter([r"^\*\s", BLANK], [r"^[<>]\s", r"^HTTP/", r"^\s*[\{\[]", r"^\*\s+Connection\s+.*intact"]), _truncate(60, "... ({n} lines omitted) ...")], 400, 6, 4),
    Filter("curl_json", [r"^\s*curl\b", r"^\s*httpie\b", r"^\s*http\s"], [Step("json", items=5, chars=240), _filter([BLANK], [r"^HTTP/", r"^\s*\{", r"^\s*\[", r"^[<>*]"]), _truncate(50, "... ({n} lines omitted) ...")], 500, 10, 5),
    Filter("generic", [r".*"], [Step("json", items=5, chars=240), _filter([BLANK], []), Step("dedup", threshold=0.85, form="{line} (x{count})"), _truncate(120, "... {n} lines omitted ...")], 1500, 10, 10),
]
