"""Keyword lists of the tier classifier; tested as plain substrings of lower-cased text."""

# Fixed values.
MEDICAL = ("diagnosis", "diagnosed", "prescription", "medication", "doctor", "therapist", "therapy", "depression", "anxiety", "mental health", "panic attack", "hospital", "patient", "symptom", "dosage", "mg ", "mri", "x-ray", "blood test", "biopsy")
LEGAL = ("lawsuit", "lawyer", "attorney", "court", "settlement", "deposition", "subpoena", "plaintiff", "defendant", "litigation", "legal advice", "confidential", "non-disclosure", "nda", "indictment", "case number")
FINANCIAL = ("bank account", "iban", "routing number", "credit card", "social security", "ssn", "tax return", "salary", "income", "net worth", "loan", "mortgage", "balance is", "account balance", "wire transfer")
PERSONAL = ("my sister", "my brother", "my mother", "my father", "my mom", "my dad", "my wife", "my husband", "my partner", "my girlfriend", "my boyfriend", "my son", "my daughter", "my child", "my kids", "my family", "fight with", "argued with", "broke up", "divorce", "miscarriage", "addiction")
PRIVATE = MEDICAL + LEGAL + FINANCIAL + PERSONAL
SECRET = ("api_key", "api key", "secret_key", "secret key", "secret_access_key", "private_key", "private key", "access_token", "access token", "bearer ", "password:", "passwd:", "pwd:")
