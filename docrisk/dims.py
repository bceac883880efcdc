"""Check names, weights, bank keys and message texts.

These must equal the screening service's own values for results to agree, so they are
stated here once and everything else is generated from them. All of them are constants
of a few dozen entries at most, which is what makes it safe to fold them into expressions.
"""

from __future__ import annotations

# --- fixed values: the 25 document checks -------------------------------------------
CHECK_NAMES = [
    "ocrConsistency",
    "fontConsistency",
    "fontSizeConsistency",
    "characterSpacing",
    "lineSpacing",
    "textAlignment",
    "baselineConsistency",
    "compressionArtifacts",
    "copyPasteRegions",
    "editingTraces",
    "photoshopArtifacts",
    "aiGeneratedIndicators",
    "logoConsistency",
    "stampConsistency",
    "signatureConsistency",
    "dateConsistency",
    "amountConsistency",
    "currencyFormatting",
    "ibanFormatting",
    "swiftFormatting",
    "qrBarcodeConsistency",
    "layoutIntegrity",
    "suspiciousElements",
    "documentTypeConsistency",
    "imageQuality",
]

CHECK_STATUSES = ["pass", "review", "suspicious", "unknown"]

RISK_LABELS = ["LOW RISK", "MODERATE RISK", "HIGH RISK", "VERY HIGH RISK"]

# --- fixed values: category weights and check weights, in summation order -------------
CATEGORY_WEIGHTS = {
    "visualRisk": 0.15,
    "textRisk": 0.15,
    "layoutRisk": 0.15,
    "financialDataRisk": 0.25,
    "editingRisk": 0.30,
}

CHECK_WEIGHTS = {
    "visualRisk": {
        "compressionArtifacts": 1.0,
        "aiGeneratedIndicators": 1.0,
        "logoConsistency": 1.0,
        "stampConsistency": 0.8,
        "signatureConsistency": 0.8,
        "imageQuality": 0.7,
    },
    "textRisk": {
        "ocrConsistency": 1.0,
        "fontConsistency": 1.0,
        "fontSizeConsistency": 0.9,
        "characterSpacing": 0.8,
        "lineSpacing": 0.7,
        "textAlignment": 0.7,
        "baselineConsistency": 0.8,
        "dateConsistency": 0.8,
        "currencyFormatting": 0.8,
        "ibanFormatting": 0.8,
        "swiftFormatting": 0.7,
    },
    "layoutRisk": {
        "textAlignment": 0.8,
        "baselineConsistency": 0.7,
        "logoConsistency": 0.8,
        "qrBarcodeConsistency": 0.7,
        "layoutIntegrity": 1.0,
        "documentTypeConsistency": 0.9,
    },
    "financialDataRisk": {
        "dateConsistency": 0.8,
        "amountConsistency": 1.0,
        "currencyFormatting": 0.8,
        "ibanFormatting": 0.8,
        "swiftFormatting": 0.7,
        "qrBarcodeConsistency": 0.5,
        "suspiciousElements": 0.8,
    },
    "editingRisk": {
        "copyPasteRegions": 1.0,
        "editingTraces": 1.0,
        "photoshopArtifacts": 1.0,
        "aiGeneratedIndicators": 0.8,
        "suspiciousElements": 1.0,
        "fontConsistency": 0.6,
        "fontSizeConsistency": 0.5,
        "characterSpacing": 0.5,
        "baselineConsistency": 0.5,
    },
}

# Checks that compare a document with its issuer's template (layout, typography, logo,
# date, amount and IBAN format); a deviation counts only when several agree.
TEMPLATE_CHECKS = [
    "documentTypeConsistency",
    "layoutIntegrity",
    "textAlignment",
    "fontConsistency",
    "fontSizeConsistency",
    "logoConsistency",
    "dateConsistency",
    "currencyFormatting",
    "ibanFormatting",
]

# --- fixed values: banks ----------------------------------------------------------------
BANK_NAMES = {
    "akbank": "Akbank",
    "garanti": "Garanti BBVA",
    "enpara": "Enpara",
    "vakifbank": "VakıfBank",
    "isbankasi": "İş Bankası",
    "ziraat": "Ziraat Bankası",
    "denizbank": "Denizbank",
    "halkbank": "Halkbank",
    "yapikredi": "Yapı Kredi",
}

# garanti is a known bank without a template
BANK_TEMPLATES = {
    "akbank": "akbank.pdf",
    "enpara": "enpara.pdf",
    "vakifbank": "vakifbank.pdf",
    "isbankasi": "isbankasi.pdf",
    "ziraat": "ziraat.pdf",
    "denizbank": "denizbank.pdf",
    "halkbank": "halkbank.pdf",
    "yapikredi": "yapikredi.pdf",
}

# --- fixed values: claim fields and their labels -----------------------------------------
CLAIM_FIELDS = ["senderName", "recipientName", "amount", "currency", "iban"]

CLAIM_FIELD_LABELS = {
    "senderName": "Gönderen adı",
    "recipientName": "Alıcı adı",
    "amount": "Tutar",
    "currency": "Para birimi",
    "iban": "IBAN",
}

# --- fixed values: items that must not change between the frames of one video ------------
FRAME_FIELDS = [
    "name",
    "surname",
    "sender",
    "recipient",
    "iban",
    "account_no",
    "transaction_no",
    "reference_no",
    "date",
    "time",
    "amount",
    "currency",
    "description",
    "bank",
    "logo",
    "qr_code",
    "barcode",
    "text",
    "digits",
]

# --- fixed values: items that must not change between the pages of one statement ---------
PAGE_FIELDS = ["holder", "iban", "account_no", "period", "currency"]

# --- fixed values: warning texts of the chain scores --------------------------------------
TOKEN_WARNINGS = {
    "TOKEN_UNSAFE": "TRONSCAN tokenı güvensiz olarak işaretliyor.",
    "TOKEN_SUSPECT": "TRONSCAN tokenı şüpheli olarak işaretliyor.",
    "TOKEN_LEVEL_UNKNOWN": "Token güvenlik seviyesi bilinmiyor.",
    "TOKEN_NOT_VIP": "Token TRONSCAN VIP/kurumsal token olarak doğrulanmamış.",
    "SUPPLY_INCREASABLE": "Toplam token arzı artırılabilir.",
    "BLACKLIST_FEATURE": "Token blacklist/freeze özelliğine sahip olabilir.",
    "NOT_OPEN_SOURCE": "Token kontratı açık kaynak olarak doğrulanmamış.",
    "PROXY_CONTRACT": "Token proxy kontrat kullanıyor.",
    "NO_LIQUIDITY": "SunSwap likiditesi bulunamadı veya sıfır görünüyor.",
    "LOW_LIQUIDITY": "Token likiditesi çok düşük.",
}

# {} is filled with the tag or the number of transfers
WALLET_WARNINGS = {
    "ACCOUNT_FLAGGED": "TRONSCAN bu adresi riskli olarak işaretliyor.",
    "PUBLIC_TAG": "Adres etiketi: {}",
    "VIP_ACCOUNT": "Adres TRONSCAN üzerinde doğrulanmış/VIP bir hesap olarak işaretli.",
    "NO_TRANSACTIONS": "Adres için işlem geçmişi bulunamadı.",
    "TRANSFERS_FOUND": "Son işlemler arasında {} TRC20 transferi bulundu.",
    "NO_TRANSFERS": "Son TRC20 transferleri bulunamadı.",
    "VERY_NEW": "Adres çok yeni oluşturulmuş görünüyor.",
    "NEW": "Adres nispeten yeni.",
}

CHAIN_DISCLAIMER = (
    "Bu sonuç blockchain verilerine dayalı otomatik güvenlik taramasıdır. "
    "Kesin olarak sahte veya gerçek olduğunu kanıtlamaz."
)

# --- fixed values: IBAN length per country (public registry) -------------------------------
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22,
    "BH": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}

# --- fixed values: limits -------------------------------------------------------------------
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_FRAMES = 8
FRAMES_PER_SECOND = 2
MAX_TRANSFERS = 20
DEDUP_HORIZON = "10 minutes"
SUSPICIOUS_FROM = 46
ARITHMETIC_BONUS = 10
AMOUNT_TOLERANCE = 0.01

# --- fixed values: error and fallback texts ----------------------------------------------------
NO_UPLOAD = "Dosya alınamadı. image, file veya video alanı bulunamadı."
EMPTY_FILE = "Dosya boş."
TOO_LARGE = "maxFileSize exceeded"
UNSUPPORTED_TYPE = "Desteklenmeyen dosya türü."
EMPTY_ANSWER = "OpenAI boş cevap döndürdü."
INVALID_ANSWER = {
    "statement": "Hesap özeti analiz sonucu geçersiz.",
    "video": "Video analiz sonucu geçersiz.",
    "receipt": "OpenAI geçerli JSON döndürmedi.",
}
INVALID_ADDRESS = "Geçerli bir TRON adresi girin."
NO_ACCOUNT = "Crypto analizinde hata oluştu."
EVIDENCE_DEFAULT = {"receipt": "Analiz tamamlandı.", "video": "Video analizi tamamlandı."}

# --- fixed values: message texts -----------------------------------------------------------------
RULE_LINE = "━━━━━━━━━━━━━━"
REPORT_TITLES = {"receipt": "ANALİZ SONUCU", "statement": "HESAP ÖZETİ ANALİZİ"}
REPORT_NOTE = (
    "Bu sonuç yalnızca otomatik ön inceleme sonucudur.\n"
    "Kesin gerçeklik veya sahtecilik kararı değildir."
)
SUMMARY_DEFAULT = "Analiz tamamlandı."
CLAIM_TITLE = "KULLANICI BİLGİSİ KONTROLÜ"
CLAIM_CONSISTENT = "Girilen bilgiler dekontta görünen bilgilerle uyumlu görünüyor."
CLAIM_MISMATCH = "UYARI: Girilen bilgiler ile dekont arasında farklılık bulundu."
CLAIM_UNVERIFIED = "Girilen bilgilerin bazıları dekont üzerinden güvenilir şekilde doğrulanamadı."
CLAIM_NOTE = "Bu kontrol risk skoruna dahil edilmemiştir."
FIELD_MISMATCH = "Uyuşmuyor."

ROUTE_MESSAGES = {
    "no_original": "Seçimin ait olduğu belge artık yok. Belgeyi yeniden yollayın.",
    "no_file": "Belgenin dosyasına ulaşılamadı. Belgeyi yeniden yollayın.",
    "invalid_choice": "Böyle bir seçenek yok.",
    "statement_video": "Videodan hesap özeti okunamaz. PDF ya da görsel yollayın.",
    "ask_file": "İncelenecek bir belge yollayın.",
    "unsupported_file": "Bu türde dosya incelenmiyor. PDF, görsel ya da video yollayın.",
    "menu": "Belge ulaştı. Bir inceleme seçin:",
    "welcome": "Bir dekont ya da hesap özeti yollayın.",
    "help": "Önce incelenecek belgeyi yollayın.",
}
DIGIT_STATES = ("no_text", "too_few", "no_repeats", "ready")
PROCESS_ERROR = "işlem hatası."
UNKNOWN_ERROR = "Bilinmeyen hata"
UNREADABLE = "Okunamayan kayıt."
