"""They must equal those of the system whose results this engine gives, so they are stated as they are."""

# Topics and their search terms, in order.
TOPIC_TERMS = [
    ("thaharah_wudhu", "الوضوء وضوء طهارة"),
    ("thaharah_mandi_wajib", "الغسل غسل جنابة"),
    ("najis", "النجاسة نجاسة"),
    ("najis_ringkan", "النجاسة المخففة بول طفل"),
    ("najis_sedang", "النجاسة المتوسطة دم"),
    ("najis_berat", "النجاسة المغلظة كلب خنزير"),
    ("shalat_lima_waktu", "الصلاة صلاة فرض"),
    ("shalat", "الصلاة صلاة"),
    ("syahadat", "الشهادة شهادة توحيد إسلام"),
    ("zakat_fitrah", "زكاة الفطر"),
    ("zakat_harta", "الزكاة زكاة نصاب"),
    ("puasa_ramadhan", "الصيام رمضان صوم"),
    ("puasa_muallaf_tengah_ramadhan", "الصيام المسلم الجديد رمضان"),
    ("makanan_haram_umum", "المحرمات حرام أكل"),
    ("makanan_haram_minuman", "الخمر مسكر حرام"),
    ("makanan_halal_penyembelihan", "الذبيحة ذبح حلال"),
    ("aurat_laki_laki", "عورة الرجل"),
    ("aurat_perempuan_shalat", "عورة المرأة الصلاة"),
    ("aurat_perempuan_di_luar_shalat", "الحجاب عورة النساء"),
    ("keluarga_non_muslim_hubungan", "أهل الذمة الكفار قرابة"),
    ("muallaf_status", "المؤلفة قلوبهم مسلم جديد"),
    ("pernikahan_suami_islam_istri_kafir", "النكاح كافر فسخ"),
    ("pernikahan_istri_islam_suami_kafir", "الفسخ نكاح مرأة مسلمة"),
    ("pernikahan_keduanya_islam", "النكاح إسلام زوجان"),
    ("waris_perbedaan_agama", "الميراث اختلاف الدين"),
    ("waris_muallaf_keluarga_non_muslim", "الميراث كافر مسلم"),
    ("jenazah_ghusl", "غسل الميت الجنازة"),
    ("jenazah_takfin", "التكفين كفن"),
    ("jenazah_shalat", "صلاة الجنازة"),
    ("jenazah_dafan", "الدفن القبر"),
    ("jenazah_keluarga_non_muslim", "جنازة كافر تعزية"),
]

# Domain by substring of a query, first match.
DOMAIN_SUBSTRINGS = [
    ("thaharah", "tahara"), ("wudhu", "tahara"), ("najis", "tahara"), ("mandi", "tahara"), ("tayammum", "tahara"),
    ("shalat", "salat"), ("solat", "salat"), ("zakat", "zakat"), ("puasa", "sawm"), ("ramadhan", "sawm"),
    ("pernikahan", "munakahah"), ("nikah", "munakahah"), ("talak", "munakahah"), ("muamalat", "muamalat"),
    ("jual_beli", "muamalat"), ("aqidah", "aqidah"), ("tauhid", "aqidah"), ("tafsir", "tafsir"),
]

# Domain, search terms, preferred authority levels, keywords.
DOMAINS = [
    ("tahara", ["الطهارة", "الوضوء", "الغسل", "التيمم", "الحدث", "النجاسة", "النية", "الاستنجاء"], [1, 2, 3],
     ["wudhu", "wudu", "ghusl", "mandi", "tayammum", "tahara", "najis", "hadats", "hadas", "junub", "istinja", "bersuci", "thaharah"]),
    ("salat", ["الصلاة", "الأذان", "الإقامة", "القبلة", "الركعة", "السجود", "الركوع", "الإمام", "الجماعة", "الفاتحة", "التشهد", "القنوت"], [1, 2, 3],
     ["shalat", "salat", "solat", "sholat", "sujud", "ruku", "qiblat", "kiblat", "adzan", "azan", "iqamah", "jamaah", "tahajud", "dhuha"]),
    ("zakat", ["الزكاة", "الصدقة", "النصاب", "الحول", "زكاة الفطر", "المصارف", "الأصناف"], [1, 2, 3],
     ["zakat", "infaq", "sedekah", "shadaqah", "nisab", "haul", "fitrah", "fitri", "mustahiq"]),
    ("sawm", ["الصيام", "الصوم", "رمضان", "الإفطار", "الكفارة", "السحور", "الاعتكاف"], [1, 2, 3],
     ["puasa", "sawm", "shaum", "ramadhan", "iftar", "sahur", "itikaf", "kafarat"]),
    ("hajj", ["الحج", "العمرة", "الإحرام", "الطواف", "السعي", "الوقوف", "المناسك", "الميقات"], [1, 2, 3],
     ["haji", "umrah", "ihram", "tawaf", "sai", "wukuf", "manasik", "miqat"]),
    ("munakahah", ["النكاح", "الطلاق", "الزواج", "المهر", "العدة", "الخلع", "الرجعة", "الولي"], [3, 4],
     ["nikah", "pernikahan", "kawin", "talak", "cerai", "mahar", "iddah", "khuluk", "wali"]),
    ("muamalat", ["البيع", "الإجارة", "الرهن", "القرض", "الشركة", "الوكالة", "الغصب", "الضمان"], [3, 4],
     ["jual beli", "muamalat", "sewa", "gadai", "pinjam", "riba", "utang", "kontrak"]),
    ("aqidah", ["التوحيد", "الإيمان", "الكفر", "الشرك", "العقيدة", "أسماء الله", "الصفات"], [1, 5],
     ["aqidah", "akidah", "iman", "tauhid", "kufur", "syirik", "aqeedah"]),
    ("tafsir", ["التفسير", "الآية", "السورة", "القرآن", "الأحكام", "التأويل"], [5],
     ["tafsir", "ayat", "surah", "quran", "qur'an", "penafsiran"]),
    ("general", [], [1, 2, 3, 4, 5], []),
]

# Score of an authority level, the score of any other, and what a preferred level adds.
AUTHORITY_SCORE = {1: 1.00, 2: 0.85, 3: 0.70, 4: 0.55, 5: 0.40}
OTHER_AUTHORITY_SCORE = 0.40
PREFERENCE_BOOST = 0.15
# Labels of the levels.
AUTHORITY_LABEL = {1: "Qawl Imam", 2: "Qawl Ashhab", 3: "Mu'tamad", 4: "Syarh Mu'tamad", 5: "Tafsir / Qawa'id"}
# Order of levels in the second search, and the rank of all others.
LEVEL_ORDER = ["mutamad", "mutamad_ensiklopedis", "sharh_mutamad_hijaz", "sharh_mutamad_mesir", "pesantren_nusantara", "pesantren"]
LEVEL_ORDER_OTHER = 9

# Words that mark a language.
ID_MARKERS = "yang ini adalah untuk dengan dan atau tidak dari pada dalam ke di bagaimana apa mengapa boleh hukum cara apakah".split()
EN_MARKERS = "the is are and or for with not how what why islamic allowed haram halal".split()
# Words that are no content.
STOPWORDS = (
    "yang ini itu adalah untuk dengan dan atau tidak dari pada dalam ke di ya bisa sudah saya apa bagaimana apakah mohon tolong jelaskan "
    "the is are and or for with not a an"
).split()
# What marks each type of input; the first that fits counts.
QUESTION_STARTS = ["apa", "bagaimana", "apakah", "mengapa", "kapan", "siapa", "what", "how", "why", "is ", "are "]
EXPLAIN_STARTS = ["jelaskan", "ceritakan", "uraikan", "explain", "describe", "tell me"]
RULING_WORDS = ["hukum", "boleh", "halal", "haram", "mubah", "wajib", "sunnah", "makruh", "allowed", "permitted"]
PROCEDURE_WORDS = ["cara", "langkah", "bagaimana cara", "how to", "steps", "tutorial"]
INPUT_TYPES = ["pertanyaan", "permintaan_penjelasan", "permintaan_fatwa", "permintaan_prosedur", "pernyataan"]

# Keywords of each domain of a question.
LEXICON = [
    ("syahadat", ["syahadat", "shahada", "tauhid", "iman", "kalimat", "syahadah", "la ilaha", "muallaf", "masuk islam", "murtad"]),
    ("shalat", ["shalat", "salat", "solat", "wudhu", "wudu", "tayamum", "qiblat", "azan", "iqamah", "rakaat", "sujud", "ruku", "fardhu", "sunnah", "jamaah", "imam"]),
    ("zakat", ["zakat", "fitrah", "maal", "nisab", "haul", "amil", "infak", "sedekah", "wakaf", "mustahik"]),
    ("puasa", ["puasa", "saum", "shaum", "ramadan", "ramadhan", "sahur", "buka", "iftar", "fidyah", "kafarat", "itikaf"]),
    ("haji", ["haji", "hajj", "umrah", "ihram", "tawaf", "sai", "wukuf", "arafah", "mina", "muzdalifah", "mabit", "dam"]),
    ("nikah", ["nikah", "pernikahan", "perkawinan", "mahar", "wali", "saksi", "talak", "cerai", "rujuk", "iddah", "nafkah", "poligami", "mahram", "khitbah"]),
    ("thaharah", ["thaharah", "taharah", "najis", "suci", "bersuci", "mandi", "wajib", "haid", "nifas", "junub", "hadats", "istinja"]),
    ("aqidah", ["aqidah", "akidah", "iman", "tauhid", "rukun", "asmaul", "husna", "sifat", "allah", "rasul", "nabi", "malaikat", "kitab", "qada", "qadar", "akhirat", "surga", "neraka"]),
    ("muamalah", ["muamalah", "jual", "beli", "riba", "hutang", "utang", "gadai", "sewa", "ijarah", "mudharabah", "musyarakah", "halal", "haram", "hukum", "bisnis", "investasi"]),
    ("jinayah", ["jinayah", "hudud", "qisas", "diyat", "hukuman", "pidana", "zina", "mencuri", "minum", "murtad", "qadzaf"]),
    ("faraid", ["faraid", "waris", "warisan", "pewaris", "ahli waris", "wasiat", "hibah", "pusaka", "hak waris"]),
    ("umum", ["islam", "muslim", "muslimah", "doa", "dzikir", "tasbih", "istighfar", "taubat", "akhlak", "adab", "sunnah"]),
]

# Domain, input type, context, evidence required, school, urgency.
CONTEXTS = [
    ("syahadat", "permintaan_fatwa", "masuk_islam_prosedur", True, "shafii", "high"),
    ("syahadat", "pertanyaan", "aqidah_tauhid", True, "shafii", "medium"),
    ("shalat", "permintaan_fatwa", "shalat_hukum", True, "shafii", "high"),
    ("shalat", "permintaan_prosedur", "shalat_tata_cara", False, "shafii", "medium"),
    ("shalat", "pertanyaan", "shalat_umum", True, "shafii", "medium"),
    ("zakat", "permintaan_fatwa", "zakat_hukum", True, "shafii", "high"),
    ("zakat", "pertanyaan", "zakat_ketentuan", True, "shafii", "medium"),
    ("puasa", "permintaan_fatwa", "puasa_hukum", True, "shafii", "high"),
    ("puasa", "permintaan_prosedur", "puasa_pelaksanaan", False, "shafii", "medium"),
    ("puasa", "pertanyaan", "puasa_umum", True, "shafii", "medium"),
    ("haji", "permintaan_prosedur", "haji_manasik", True, "shafii", "high"),
    ("haji", "pertanyaan", "haji_umum", True, "shafii", "medium"),
    ("nikah", "permintaan_fatwa", "nikah_hukum", True, "shafii", "high"),
    ("nikah", "pertanyaan", "nikah_ketentuan", True, "shafii", "medium"),
    ("muamalah", "permintaan_fatwa", "muamalah_hukum", True, "shafii", "high"),
    ("muamalah", "pertanyaan", "muamalah_umum", True, "shafii", "medium"),
    ("thaharah", "permintaan_prosedur", "thaharah_tata_cara", False, "shafii", "medium"),
    ("thaharah", "permintaan_fatwa", "thaharah_hukum", True, "shafii", "medium"),
    ("aqidah", "pertanyaan", "aqidah_penjelasan", True, "shafii", "medium"),
    ("aqidah", "permintaan_penjelasan", "aqidah_detail", True, "shafii", "high"),
]
DEFAULT_CONTEXT = ("umum_islam", True, "shafii", "low")
SENSITIVE_CONTEXTS = ["jinayah_hukum", "faraid", "muamalah_hukum"]
# Urgency, strategy, least evidence, partial answers allowed, depth.
STRATEGIES = [("high", "comprehensive", 3, False, "full"), ("medium", "targeted", 2, True, "standard"), ("low", "minimal", 1, True, "brief")]

# Patterns that a question must not have, in order.
SUSPICIOUS = ["<[^>]+>", "(?i)javascript\\s*:", "(?i)on\\w+\\s*=", "--", "(?i);\\s*(drop|insert|update|delete|select)", "\\.\\./"]
QUESTION_LENGTH = (3, 500)
SCHOOLS = ["shafii", "hanafi", "maliki", "hanbali"]

# Topics hinted at by a passage, in order.
TOPIC_HINTS = [
    ("thaharah", "(طهار|وضوء|غسل|تيمم|نجاس)"),
    ("shalat", "(صلا|ركوع|سجود|قيام|إمام|جماع)"),
    ("zakat", "(زكا|نصاب|أموال|فقير|مسكين)"),
    ("puasa", "(صوم|صيام|إفطار|سحور|رمضان)"),
    ("haji", "(حج|عمر|إحرام|طواف|سعي|منى)"),
    ("nikah", "(نكاح|زواج|طلاق|مهر|ولي|شهود)"),
    ("waris", "(وراث|إرث|تركة|فريضة|عصبة)"),
    ("muamalah", "(بيع|شرا|إجار|رها|قرض|ربا)"),
    ("jenazah", "(جنازة|ميت|دفن|تكفين|غسل الميت)"),
    ("hudud", "(حدود|قصاص|دية|حد|زنا|سرق)"),
]
# Words that open a chapter.
CHAPTER_OPENERS = "كتاب باب فصل مسألة فروع تنبيه خاتمة مقدمة قاعدة".split()

# Texts of answers.
PLACEHOLDER = "[akan ditambahkan]"
NO_ANSWER = "Maaf, pertanyaan ini belum ada di database kami. Silakan tanya kepada ulama setempat."
NO_MATCH = "Pertanyaan tidak cocok dengan topik yang ada dalam database. Silakan tanyakan kepada ulama setempat."
MEDIUM_NOTE = "⚠️  Catatan: Hukum ini berdasarkan dalil yang tersedia dalam database. Untuk kepastian, konsultasikan dengan ulama atau ustaz terpercaya."
MEDIUM_BOOK_NOTE = "⚠️  Catatan: Jawaban ini merujuk pada teks kitab klasik dalam korpus. Untuk kepastian hukum, konsultasikan dengan ulama atau ustaz terpercaya."
INSUFFICIENT_NOTE = "❌  Database tidak memiliki cukup dalil untuk menjawab pertanyaan ini dengan keyakinan yang memadai. Mohon tanyakan langsung kepada ulama atau ustaz."
LOW_WARNING = "Confidence terlalu rendah untuk dijawab secara otomatis."
BOOK_WARNING = "Jawaban bersumber dari teks kitab korpus; dalil Quran/hadis belum dipetakan secara eksplisit dalam database."
HASAN_WARNING = "Hadis '{}' berstatus hasan, bukan sahih."
DHAIF_WARNING = "Hadis '{}' berstatus dhaif dan tidak menambah confidence."
CORPUS_NOTE = (
    "📚 Jawaban ini diambil dari korpus kitab klasik melalui pencarian teks penuh (full-text search). Kutipan ditampilkan sesuai relevansi teks Arab, bukan "
    "penilaian kontekstual seorang ulama. Pastikan memverifikasi dengan membaca kitab asli atau berkonsultasi dengan ulama yang berkompeten."
)

# The ruling of topics that are answered by the theme of cached verses.
THEME_RULING = "Lihat referensi Quran dan hadis terkait."
