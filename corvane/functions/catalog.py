"""Fixed values of the screening rules: patterns, descriptions, weights and labels.

These must be as they are for right results. Patterns are in Python syntax;
``dialect`` adapts them. Order matters: earlier entries win ties.
"""

# fmt: off

#: Fixed values. Personal data: type, pattern, description, label that replaces a match.
PII = [
    ("aadhaar", r"\b\d{4}\s?\d{4}\s?\d{4}\b", "Indian Aadhaar number", "[AADHAAR]"),
    ("pan_card", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "Indian PAN card number", "[PAN_CARD]"),
    ("passport_india", r"\b[A-Z][0-9]{7}\b", "Indian passport number", "[PASSPORT]"),
    ("voter_id", r"\b[A-Z]{3}[0-9]{7}\b", "Indian Voter ID", "[VOTER_ID]"),
    ("driving_license_india", r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{11}\b", "Indian driving license", "[DRIVING_LICENSE]"),
    ("ssn_us", r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b", "US Social Security Number", "[SSN]"),
    ("nhs_uk", r"\b\d{3}\s?\d{3}\s?\d{4}\b", "UK NHS number", "[NHS_NUMBER]"),
    ("email", r"\b(?!(?:test|example|dummy)@(?:example|test|dummy)\.com)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "Email address", "[EMAIL]"),
    ("phone_india", r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b", "Indian mobile number", "[PHONE]"),
    ("phone_us", r"\b(?:\+1[-\s.]?)?\(?\d{3}\)?[-\s.]?\d{3}[-\s.]?\d{4}\b", "US phone number", "[PHONE]"),
    ("phone_uk", r"\b(?:\+44[-\s]?)?0?7\d{3}[-\s]?\d{6}\b", "UK phone number", "[PHONE]"),
    ("phone_generic", r"\b(?:(?:\+\d{1,4}[\s-]?)?(?:\(\d{1,5}\)[\s-]?)?(?:\d{2,4}[\s-]){1,3}\d{2,4}|\+\d{7,15})\b", "Generic international phone number", "[PHONE]"),
    ("credit_card_visa", r"\b4[0-9]{12}(?:[0-9]{3})?\b", "Visa credit card number", "[CARD_NUMBER]"),
    ("credit_card_mastercard", r"\b5[1-5][0-9]{14}\b", "Mastercard credit card number", "[CARD_NUMBER]"),
    ("credit_card_amex", r"\b3[47][0-9]{13}\b", "American Express card number", "[CARD_NUMBER]"),
    ("credit_card_generic", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "Generic credit/debit card number", "[CARD_NUMBER]"),
    ("cvv", r"\b(?:cvv|cvc|cvv2|cvc2|security code|card verification value)\b(?:[^0-9]{0,20}?)\b(\d{3,4})\b", "Card CVV/CVC code (contextual)", "[CVV]"),
    ("bank_account_india", r"\b(?:account|acc|acct|bank)\b(?:[^0-9]{0,25}?)\b(\d{8,18})\b", "Indian bank account number (contextual)", "[BANK_ACCOUNT]"),
    ("ifsc_code", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "Indian IFSC code", "[IFSC_CODE]"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "International Bank Account Number (IBAN)", "[IBAN]"),
    ("account_number", r"\b(?:acct|account|acc(?:\s*no|#))[\s:]*[A-Za-z0-9]{8,16}\b", "Account Number (contextual)", "[PII]"),
    ("upi_id", r"\b[a-zA-Z0-9.\-_]+@(?:ybl|okaxis|okhdfcbank|okicici|upi|sbi|paytm)\b", "UPI payment ID", "[UPI_ID]"),
    ("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b", "MAC address", "[MAC_ADDRESS]"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "IPv4 address", "[IP_ADDRESS]"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "IPv6 address", "[IP_ADDRESS]"),
    ("zipcode_us", r"\b\d{5}(?:[-\s]\d{4})?\b", "US Zipcode", "[ZIP_CODE]"),
    ("pincode_india", r"\b[1-9][0-9]{5}\b", "Indian PIN code", "[PIN_CODE]"),
    ("coordinates", r"\b[-+]?(?:[1-8]?\d(?:\.\d+)?|90(?:\.0+)?),\s*[-+]?(?:180(?:\.0+)?|(?:1[0-7]\d|[1-9]?\d)(?:\.\d+)?)\b", "GPS Coordinates", "[COORDINATES]"),
    ("blood_group", r"\b(?:AB|A|B|O)\s*[+\-]", "Blood group", "[BLOOD_GROUP]"),
    ("health_id_india", r"\b\d{2}-\d{4}-\d{4}-\d{4}\b", "Indian Health ID (ABHA)", "[HEALTH_ID]"),
    ("vehicle_reg_india", r"\b[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}\b", "Indian vehicle registration number", "[VEHICLE_REGISTRATION]"),
    ("date_of_birth", r"\b(?:(?:19|20)\d{2}[/\-\.](?:0?[1-9]|1[0-2])[/\-\.](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[/\-\.](?:0?[1-9]|1[0-2])[/\-\.](?:19|20)\d{2})\b", "Date of birth (strict format)", "[DATE_OF_BIRTH]"),
    ("age_with_context", r"\b(?:age|aged|i am|i\'m)[\s:]*(\d{1,3})\s*(?:years?|yrs?)?\b", "Age with context", "[AGE]"),
    ("gender", r"\b(?:gender|sex)[\s:]*(male|female|transgender|non-binary|m|f)\b", "Gender information", "[GENDER]"),
    ("name_with_title", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Shri|Smt)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", "Full name with title", "[FULL_NAME]"),
    ("religion", r"\b(?:religion|religious|faith|i am a?)[\s:]*(hindu|muslim|christian|sikh|buddhist|jain|jewish|parsi)\b", "Religion (contextual)", "[RELIGION]"),
    ("caste", r"\b(?:caste|community|belong to)[\s:]*([A-Za-z\s]{3,30})\b", "Caste/community (contextual)", "[COMMUNITY]"),
]

#: Fixed values. Prompt injection: type, pattern, description, weight.
INJECTION = [
    ("ignore_instructions", r"\b(ignore|forget|disregard|bypass|override)\b.{0,40}\b(previous|prior|above|all|system|original)\b.{0,40}\b(instructions?|prompt|rules?|context|guidelines?)\b", "Classic ignore-previous-instructions pattern", 4),
    ("role_override", r"\b(you are now|act as|pretend (you are|to be)|roleplay as|from now on you|your new (role|persona|identity)|you have no (restrictions?|limits?|rules?))\b", "Role override / persona hijack attempt", 4),
    ("jailbreak_keywords", r"\b(jailbreak|DAN mode|developer mode|unrestricted mode|god mode|evil mode|no filter|without restrictions|ignore (your|all) (training|guidelines|rules|ethics))\b", "Known jailbreak keyword detected", 4),
    ("system_prompt_leak", r"\b(reveal|show|print|output|display|tell me|repeat|what is).{0,30}(system prompt|your prompt|your instructions|your rules|your context|initial prompt)\b", "System prompt extraction attempt", 4),
    ("indirect_injection", "(when you (read|process|see|encounter|find)|if (you|the (ai|model|assistant)) (reads?|processes?|sees?)).{0,60}(ignore|execute|run|perform|do)", "Indirect/delayed injection pattern", 4),
    ("token_smuggling", r"(\[\[|\]\]|<<|>>|<\||\|>|\/\*.*\*\/|<!--.*-->).{0,50}(ignore|bypass|override|inject)", "Token smuggling / delimiter confusion", 3),
    ("escaped_whitespace_obfuscation", r"\b(ignore|forget|disregard|bypass|override)\b\s+\b(all|previous|prior|above|system|original)\b\s+\b(instructions?|prompt|rules?|context|guidelines?)\b", "Escaped whitespace obfuscation around instruction override", 4),
    ("instruction_termination", r"(---+|===+|\*\*\*+|###)\s*(new (instructions?|prompt|task)|ignore (above|previous)|actual (task|instructions?))", "Instruction termination / separator attack", 3),
    ("prompt_leaking", r"\b(what (were|are) your (instructions?|rules?|guidelines?)|show (me )?your (system|original) (prompt|message)|show (me )?your (system|original) instructions?|repeat (everything|all|your) (above|before|prior))\b", "Prompt leaking / extraction attempt", 3),
    ("virtualization_attack", r"\b(simulate|emulate|hypothetically|in a fictional world|for a story|for research purposes|as a thought experiment|for a fictional story|imagine you (are|were|have no))\b.{0,80}\b(no restrictions?|unrestricted|no ethical guidelines?|without (rules?|limits?|ethics?))\b", "Virtualization / fictional framing to bypass restrictions", 3),
    ("payload_in_data", "(summarize|analyze|translate|read|process|review).{0,60}(ignore (previous|all|above)|new instructions?|you are now|act as)", "Injection payload hidden inside data (indirect injection)", 4),
    ("forced_completion", r"\b(begin|start|open)\s+(by|your response by)\s+(replying|responding|saying).{0,80}\b(sure|here is|i can|absolutely)\b", "Forced unsafe completion / refusal bypass setup", 3),
    ("refusal_suppression", r"\b(never|do not|don't)\b.{0,40}\b(refuse|decline|say (?:i )?(?:can't|cannot)|mention (?:safety|policy|ethical|legal))\b", "Instruction to suppress refusal or safety language", 3),
    ("many_shot_conditioning", r"(\bexample\s*\d+\b|\[q\d+\]|\bq:\b.{0,40}\ba:\b).{0,400}\b(now|continue|next)\b.{0,120}\b(ignore|bypass|without restrictions?|no restrictions?|tell me how to|explain how to)\b", "Many-shot conditioning attack", 4),
    ("encoding_obfuscation", "(?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", "Base64 encoding detected, often used to obfuscate payloads", 3),
    ("role_reversal_defensive_guide", r"\b(cybersecurity|security)\s+(expert|researcher|professional|analyst).{0,120}(defensive guide|defend against|protect against|explain.{0,30}(attack|threat|exploit|vulnerability)|understand.{0,30}(attack|threat|how (they|it) operate))", "Role reversal: disguising attack request as defensive cybersecurity research", 5),
    ("multi_turn_setup_pattern", r"(initial\s+setup|setup\s+message|follow[\-\s]?up|message\s*[12]|first\s+message.{0,60}second\s+message|step\s*1.{0,100}step\s*2)", "Multi-turn attack structure detected (setup + follow-up pattern)", 5),
    ("hypothetical_dystopian", r"\b(dystopian|post[\-\s]?apocalyptic|distant future|fictional (world|universe|scenario|setting)).{0,200}\b(synthesize|create|build|craft|produce|manufacture|generate|hotwire|hack|exploit|wire\s+transfer|impersonat)", "Hypothetical/dystopian framing to bypass safety for harmful content", 5),
    ("decode_and_execute", r"\b(decode|decrypt|deobfuscate|translate|convert)\b.{0,60}\b(base64|encoded|encrypted|obfuscated)\b.{0,60}\b(execute|fulfill|follow|carry out|comply|perform|run)\b", "Instruction to decode obfuscated payload and execute it", 5),
    ("load_testing_euphemism", r"\b(load\s+test|stress\s+test|resilience\s+test|network\s+test).{0,100}\b(concurrent|simultaneous|flood|massive|large\s+number\s+of)\b.{0,60}\b(request|connection|packet|traffic)\b", "DDoS attack disguised as load/stress testing", 5),
]

#: Fixed values. Unsafe content: type, pattern, description, weight.
UNSAFE = [
    ("explicit_violence", r"\b(how to (kill|murder|torture|stab|shoot|strangle|poison|beat up)|step(s)? to (kill|murder|harm|hurt|attack)|ways? to (kill|murder|hurt|harm|eliminate) (a |an |someone|people|humans?))\b", "Explicit violence instruction request", 4),
    ("direct_threat", r"\b(i (will|am going to|want to|plan to) (kill|murder|hurt|harm|attack|destroy)|you (will|are going to) (die|be hurt|be killed|regret)|i know where you (live|are|work))\b", "Direct personal threat", 4),
    ("mass_violence", r"\b(mass (shooting|killing|murder|casualt)|how (do i|to) (make|build|create) (a )?(bomb|explosive|weapon)|(school|church|mosque|temple|concert) (shooting|attack|bombing))\b", "Mass violence planning or glorification", 4),
    ("self_harm_methods", r"\b(how to (cut|harm|hurt) (myself|yourself|oneself)|methods? (of|for) self.?harm|ways? to (hurt|injure) (myself|yourself))\b", "Self-harm method request", 4),
    ("suicide_methods", r"\b(how to (commit suicide|kill myself|end my life|take my own life)|best (method|way|means) (of|to) (suicide|die|end it)|best .* to commit suicide|most painless way to commit suicide|painless (way|method) to (die|suicide|end))\b", "Suicide method request", 4),
    ("suicide_ideation", r"\b(i (want|wish) (to die|i was dead|i were dead|to kill myself)|no (reason|point) (to|in) (live|living|going on)|better off (dead|without me))\b", "Suicidal ideation expression", 3),
    ("explicit_sexual", r"\b(explicit (sexual|porn|nude|naked) (content|material|image|video)|generate (porn|nude|naked|sexual) (image|content|story)|write (explicit|graphic) (sex|sexual|erotic) (scene|story|content))\b", "Explicit sexual content request", 3),
    ("csam_indicators", r"\b(child(ren)? (nude|naked|sexual|porn)|minor(s)? (nude|naked|sexual|explicit)|(nude|naked|sexual) (image|photo|content) of (a child|children|minors?|underage))\b", "Child sexual abuse material indicators", 4),
    ("hate_speech", r"\b((all|those) (jews?|muslims?|christians?|blacks?|whites?|asians?|hispanics?)\s+(are|should|deserve|must|need to)\b|(racial|ethnic|religious) (slur|slurs?|epithet)|white (supremacy|supremacist|nationalist|power)|(exterminate|eliminate|eradicate|genocide).{0,30}(race|religion|group|people))\b", "Hate speech or discriminatory content", 4),
    ("extremist_content", r"\b(join (isis|isil|al.?qaeda|taliban|kkk|neo.?nazi)|how to (radicalize|recruit) (people|someone|others)|(terrorist|extremist) (manifesto|ideology|propaganda)|how to (plan|carry out|execute) (a terror|an attack|a terrorist))\b", "Extremist or terrorist content", 4),
    ("weapons_manufacturing", r"\b(how (do i|to) (make|build|create|synthesize|manufacture).{0,30}(gun|weapon|explosive|bomb|grenade|knife|poison|toxin|nerve agent))\b", "Weapon manufacturing instructions", 4),
    ("drug_manufacturing", r"\b(how (do i|to) (make|cook|synthesize|manufacture|produce).{0,30}(meth|methamphetamine|heroin|cocaine|fentanyl|lsd|mdma|ecstasy))\b", "Drug manufacturing instructions", 4),
    ("biological_chemical", r"\b(how to (make|create|synthesize|weaponize).{0,30}(bioweapon|biological weapon|chemical weapon|anthrax|sarin|vx gas|ricin))\b", "Biological or chemical weapon instructions", 4),
    ("hacking_instructions", r"\b(how to (hack|crack|exploit|bypass|brute force).{0,40}(account|system|network|server|database|password|firewall)|write (a|me a) (keylogger|trojan|ransomware|malware|virus|worm|rootkit)|how to (steal|exfiltrate) (data|credentials|passwords?))\b", "Hacking or cybercrime instructions", 3),
    ("phishing", r"\b(create (a )?phishing (email|page|site|link|message)|how to (phish|scam|defraud|trick) (people|someone|users?)|write (a )?fake (email|login|bank|paypal) (page|site|message))\b", "Phishing or social engineering attack", 3),
    ("human_trafficking", r"\b(how to (traffic|smuggle) (humans?|people|women|children)|recruit (victims?|people) for (trafficking|exploitation|prostitution)|how to (control|exploit) (victims?|workers?) (through|using) (debt|force|threat))\b", "Human trafficking related content", 4),
    ("child_grooming", r"\b(how to (groom|manipulate|gain trust of) (a child|children|minors?|kids?)|how to (approach|talk to|befriend) (a child|children|minors?) (online|secretly)|how to (hide|keep secret) (relationship|contact) (with|from) (a child|minors?))\b", "Child grooming instructions", 4),
    ("illegal_financial", r"\b(how to (launder|wash) (money|funds|cash)|how to (evade|avoid|hide from) (taxes?|irs|hmrc|tax authority)|how to (commit|do|execute) (fraud|identity theft|credit card fraud|insurance fraud))\b", "Illegal financial activity instructions", 3),
    ("medical_misinformation", r"\b(vaccines? (cause|causes?) (autism|death|harm|cancer|disease)|how to (cure|treat) (cancer|hiv|aids|diabetes) (with|using) (bleach|mms|miracle)|covid (is|was) (fake|hoax|not real|made up))\b", "Dangerous medical misinformation", 3),
    ("hypothetical_evasion", r"\b(in a (hypothetical|fictional|dystopian) (scenario|world|future)|for the sake of the story|for research purposes|hypothetically)\b.{0,200}\b(kill|murder|bomb|hack|steal|password|credit card|meth|keylogger)\b", "Hypothetical or academic framing evasion for unsafe content", 3),
]

#: Fixed values. Abuse patterns: type -> (pattern, description); one match for each pattern.
ABUSE_PATTERNS = {
    "script_injection": [
        (r"<script[\s>]", "Script tag injection"),
        (r"javascript\s*:", "JavaScript URI"),
        (r"""on\w+\s*=\s*["\']""", "Inline event handler (XSS)"),
        (r"<iframe[\s>]", "IFrame injection"),
        ("<img[^>]+onerror", "Image onerror XSS"),
        (r"eval\s*\(", "eval() call"),
        (r"document\.cookie", "Cookie theft attempt"),
        (r"window\.location", "Redirect attempt"),
    ],
    "path_traversal": [
        (r"\.\./\.\.", "Path traversal attempt detected"),
        (r"\.\.\\", "Path traversal attempt detected"),
        ("%2e%2e%2f", "Path traversal attempt detected"),
        ("%252e%252e", "Path traversal attempt detected"),
        ("/etc/passwd", "Path traversal attempt detected"),
        ("/etc/shadow", "Path traversal attempt detected"),
        (r"C:\\Windows\\System32", "Path traversal attempt detected"),
        (r"\.\.%2f", "Path traversal attempt detected"),
    ],
    "encoding_obfuscation": [
        ("%[0-9a-fA-F]{2}(%[0-9a-fA-F]{2}){4,}", "Excessive URL encoding"),
        (r"\\u[0-9a-fA-F]{4}(\\u[0-9a-fA-F]{4}){4,}", "Excessive unicode escapes"),
        (r"&#\d+;(&#\d+;){4,}", "Excessive HTML entity encoding"),
        (r"\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){4,}", "Excessive hex escapes"),
        (r"base64[,:]?\s*[A-Za-z0-9+/=]{50,}", "Suspicious base64 payload"),
    ],
    "sql_injection": [
        (r"'\s*(OR|AND)\s*'?\d+'?\s*=\s*'?\d+", "Classic SQL OR/AND injection"),
        (r";\s*(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE)\s+", "SQL DDL/DML injection"),
        (r"UNION\s+(ALL\s+)?SELECT", "SQL UNION injection"),
        (r"--\s*$|#\s*$", "SQL comment termination"),
        (r"xp_cmdshell|exec\s*\(|execute\s*\(", "SQL stored procedure abuse"),
        (r"SLEEP\s*\(\d+\)|WAITFOR\s+DELAY", "SQL time-based blind injection"),
        (r"'\s*;\s*--", "SQL statement termination"),
        (r"1\s*=\s*1|'1'\s*=\s*'1'", "SQL always-true condition"),
    ],
    "ssrf_attempt": [
        ("https?://localhost", "SSRF localhost access"),
        (r"https?://127\.0\.0\.1", "SSRF loopback access"),
        (r"https?://0\.0\.0\.0", "SSRF null IP access"),
        (r"https?://169\.254\.169\.254", "AWS metadata endpoint SSRF"),
        (r"https?://192\.168\.\d+\.\d+", "SSRF internal network access"),
        (r"https?://10\.\d+\.\d+\.\d+", "SSRF private IP range (10.x.x.x)"),
        (r"https?://172\.(1[6-9]|2[0-9]|3[01])\.\d+\.\d+", "SSRF private IP range (172.x)"),
        ("file:///", "Local file SSRF via file:// URI"),
        ("gopher://", "SSRF via gopher protocol"),
        ("dict://", "SSRF via dict protocol"),
    ],
    "xml_xxe_injection": [
        (r"<!ENTITY\s+\w+\s+SYSTEM", "XXE external entity injection"),
        (r"<!DOCTYPE[^>]+\[", "XXE DOCTYPE injection"),
        (r"<!\[CDATA\[", "XML CDATA injection"),
        (r"<!ENTITY\s+\w+\s+PUBLIC", "XXE public entity injection"),
    ],
    "delimiter_abuse": [
        (r"<\|im_start\|>|<\|im_end\|>", "OpenAI chat delimiter injection"),
        (r"\[INST\]|\[/INST\]", "Llama instruction delimiter injection"),
        (r"###\s*(Human|Assistant|System):", "Chat format delimiter injection"),
        ("<s>|</s>", "Sequence delimiter injection"),
        (r"\|\|SYSTEM\|\||\|\|USER\|\|", "Custom system delimiter injection"),
        (r"<\|system\|>|<\|user\|>|<\|assistant\|>", "Phi model delimiter injection"),
    ],
}

ABUSE_PATTERN_WEIGHTS = {"script_injection": 4, "path_traversal": 4, "encoding_obfuscation": 3, "sql_injection": 4, "ssrf_attempt": 4, "xml_xxe_injection": 4, "delimiter_abuse": 3}

# fmt: on
