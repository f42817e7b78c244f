"""Message templates by language and statement layouts by bank or app. They decide what is rendered and parsed."""

from __future__ import annotations

# --- fixed values: (kind, language, template) --------------------------------------------------

LANGUAGE_TEMPLATES = [
    ("debit", "english", "{bank}: Rs.{amount} debited from A/c XX{account} on {date}. {vpa}. Ref: {ref}"),
    ("debit", "hindi", "{bank}: आपके खाते XX{account} से Rs.{amount} डेबिट हुआ। दिनांक {date}। {vpa}। संदर्भ: {ref}"),
    ("debit", "tamil", "{bank}: உங்கள் கணக்கு XX{account} இல் இருந்து Rs.{amount} டெபிட் செய்யப்பட்டது. தேதி {date}. Ref: {ref}"),
    ("debit", "telugu", "{bank}: మీ ఖాతా XX{account} నుండి Rs.{amount} డెబిట్ చేయబడింది. తేదీ {date}. {vpa}. Ref: {ref}"),
    ("debit", "bengali", "{bank}: আপনার অ্যাকাউন্ট XX{account} থেকে Rs.{amount} ডেবিট হয়েছে। তারিখ {date}। Ref: {ref}"),
    ("debit", "kannada", "{bank}: ನಿಮ್ಮ ಖಾತೆ XX{account} ನಿಂದ Rs.{amount} ಡೆಬಿಟ್ ಆಗಿದೆ. ದಿನಾಂಕ {date}. Ref: {ref}"),
    ("debit", "marathi", "{bank}: तुमच्या खात्यातून XX{account} Rs.{amount} डेबिट झाले. तारीख {date}. Ref: {ref}"),
    ("debit", "gujarati", "{bank}: તમારા ખાતા XX{account} માંથી Rs.{amount} ડેબિટ થયું. તારીખ {date}. Ref: {ref}"),
    ("credit", "english", "{bank}: Rs.{amount} credited to A/c XX{account} on {date}. {sender}. Ref: {ref}"),
    ("credit", "hindi", "{bank}: आपके खाते XX{account} में Rs.{amount} क्रेडिट हुआ। दिनांक {date}। {sender}। संदर्भ: {ref}"),
    ("credit", "tamil", "{bank}: உங்கள் கணக்கு XX{account} க்கு Rs.{amount} கிரெடிட் செய்யப்பட்டது. தேதி {date}. Ref: {ref}"),
    ("credit", "telugu", "{bank}: మీ ఖాతా XX{account} కు Rs.{amount} క్రెడిట్ చేయబడింది. తేదీ {date}. Ref: {ref}"),
    ("credit", "bengali", "{bank}: আপনার অ্যাকাউন্ট XX{account} এ Rs.{amount} ক্রেডিট হয়েছে। তারিখ {date}। Ref: {ref}"),
    ("credit", "kannada", "{bank}: ನಿಮ್ಮ ಖಾತೆ XX{account} ಗೆ Rs.{amount} ಕ್ರೆಡಿಟ್ ಆಗಿದೆ. ದಿನಾಂಕ {date}. Ref: {ref}"),
    ("credit", "marathi", "{bank}: तुमच्या खात्यात XX{account} Rs.{amount} क्रेडिट झाले. तारीख {date}. Ref: {ref}"),
    ("credit", "gujarati", "{bank}: તમારા ખાતા XX{account} માં Rs.{amount} ક્રેડિટ થયું. તારીખ {date}. Ref: {ref}"),
    ("otp", "english", "{bank}: Your OTP is {otp}. Valid for 10 mins. Do not share with anyone."),
    ("otp", "hindi", "{bank}: आपका OTP {otp} है। 10 मिनट के लिए मान्य। किसी के साथ साझा न करें।"),
    ("otp", "tamil", "{bank}: உங்கள் OTP {otp}. 10 நிமிடங்களுக்கு செல்லுபடியாகும். யாருடனும் பகிர வேண்டாம்."),
    ("otp", "telugu", "{bank}: మీ OTP {otp}. 10 నిమిషాలు చెల్లుబాటు. ఎవరితోనూ షేర్ చేయకండి."),
    ("otp", "bengali", "{bank}: আপনার OTP হল {otp}। 10 মিনিটের জন্য বৈধ। কারো সাথে শেয়ার করবেন না।"),
    ("balance", "english", "{bank}: Your A/c XX{account} balance is Rs.{balance}."),
    ("balance", "hindi", "{bank}: आपके खाते XX{account} में शेष राशि Rs.{balance} है।"),
    ("balance", "tamil", "{bank}: உங்கள் கணக்கு XX{account} இருப்பு Rs.{balance}."),
    ("balance", "telugu", "{bank}: మీ ఖాతా XX{account} బ్యాలెన్స్ Rs.{balance}."),
    ("balance", "bengali", "{bank}: আপনার অ্যাকাউন্ট XX{account} ব্যালেন্স Rs.{balance}।"),
]
LANGUAGES = ["english", "hindi", "tamil", "telugu", "bengali", "kannada", "marathi", "gujarati"]
#: Languages whose digits are known, by their codes in ``functions.normalize``.
DIGITS = {"hindi": "hi", "bengali": "bn", "tamil": "ta", "kannada": "kn"}

# --- fixed values: (source, layouts in order) ----------------------------------------------------

LAYOUTS = {
    "hdfc": [
        "{date} | {desc} | {debit} | {credit} | {balance}",
        "{date}  {desc}  DR:{debit}  BAL:{balance}",
        "{date} {desc} Withdrawal: Rs.{debit} Balance: Rs.{balance}",
    ],
    "icici": [
        "{date} | {desc} | {debit} | {credit} | {balance}",
        "{date}//ICICI//{desc}//AMT:{amount}//BAL:{balance}",
        "{date} - {desc} - Rs.{amount} - Bal: Rs.{balance}",
    ],
    "sbi": [
        "{date} | {desc} | {debit} | {credit} | {balance}",
        "SBI/{date}/{desc}/Rs.{amount}/Bal.{balance}",
        "{date} {desc} Amount: {amount} Available: {balance}",
    ],
    "axis": [
        "{date} | {desc} | {debit} | {credit} | {balance}",
        "AXIS-{date}-{desc}-{amount}-{balance}",
        "{date} >> {desc} >> Rs {amount} >> Bal Rs {balance}",
    ],
    "kotak": [
        "{date} | {desc} | {debit} | {credit} | {balance}",
        "{date} KOTAK {desc} {amount} BAL:{balance}",
        "{date}: {desc} | Amount: Rs.{amount} | Balance: Rs.{balance}",
    ],
    "phonepe": [
        "{date} | {type_text} | {merchant} | ₹{amount} | {status}",
        "{date} {time} | {merchant} | {type_text} Rs.{amount} | Txn ID: {ref}",
        "PhonePe: {type_text} of ₹{amount} to {merchant} on {date}. UPI Ref: {ref}",
        "{date} - {merchant}@ybl - ₹{amount} - {status} - Ref: {ref}",
        "Transaction: {type_text} | Amount: ₹{amount} | To: {merchant} | {date}",
        "{type_text}: ₹{amount} | {merchant} | {date} {time} | ID: {ref}",
    ],
    "gpay": [
        "{date},{merchant},{amount},{type_text},{status},{upi_id},{ref}",
        "Google Pay: {type_text} of ₹{amount} to {merchant}. {date}. Ref {ref}",
        "{date} | {merchant} | ₹{amount} {type_text} | UPI: {upi_id} | {ref}",
        "You {action} ₹{amount} {direction} {merchant}. {date}. UPI Ref: {ref}. -Google Pay",
        "GPay Transaction: {date} | {merchant} | {type_text} ₹{amount} | Ref: {ref}",
        "{date} {time} - {type_text} - {merchant} - Rs {amount} - {ref}",
    ],
    "paytm": [
        "{date} | {merchant} | {type_text} | ₹{amount} | {wallet_balance}",
        "Paytm: {type_text} of Rs.{amount} to {merchant}. {date}. Order ID: {ref}",
        "{date} {time} | {type_text} ₹{amount} | {merchant} | Paytm | Ref: {ref}",
        "You {action} Rs.{amount} to {merchant} using Paytm on {date}. ID: {ref}",
        "Transaction: {date} | {merchant} | Rs {amount} | Type: {type_text} | {status}",
        "Paytm Wallet: {type_text} Rs.{amount} | {merchant} | Balance: ₹{wallet_balance} | {date}",
    ],
}
#: (source, word of a credit, word of a debit) for {type_text}, and for {action}; others have neither.
TYPE_WORDS = {"phonepe": ("Received", "Paid"), "gpay": ("Credit", "Debit"), "paytm": ("Credit", "Debit")}
ACTION_WORDS = {"gpay": ("received", "paid"), "paytm": ("received", "sent")}
