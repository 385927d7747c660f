"""Lexicons as tables of (key, terms in order); engines take them as parameters."""

from __future__ import annotations

# Abbreviations and their expansions, in the order in which they apply.
ABBREVIATIONS = [
    ("TTD", "Tablet Tambah Darah"),
    ("BBLR", "Berat Badan Lahir Rendah"),
    ("ASI", "Air Susu Ibu"),
    ("IMD", "Inisiasi Menyusu Dini"),
    ("MPASI", "Makanan Pendamping ASI"),
    ("ANC", "Antenatal Care"),
    ("KEK", "Kurang Energi Kronis"),
    ("LiLA", "Lingkar Lengan Atas"),
    ("HPK", "Hari Pertama Kehidupan"),
    ("IMT", "Indeks Massa Tubuh"),
    ("SD", "Standar Deviasi"),
    ("Hb", "Hemoglobin"),
    ("KMS", "Kartu Menuju Sehat"),
    ("PMT", "Pemberian Makanan Tambahan"),
    ("BB", "Berat Badan"),
    ("TB", "Tinggi Badan"),
    ("PB", "Panjang Badan"),
    ("BAB", "Buang Air Besar"),
    ("BAK", "Buang Air Kecil"),
    ("ISPA", "Infeksi Saluran Pernapasan Akut"),
    ("STBM", "Sanitasi Total Berbasis Masyarakat"),
    ("CTPS", "Cuci Tangan Pakai Sabun"),
    ("JKN", "Jaminan Kesehatan Nasional"),
    ("PKH", "Program Keluarga Harapan"),
    ("BPNT", "Bantuan Pangan Non-Tunai"),
    ("TPPS", "Tim Percepatan Penurunan Stunting"),
    ("DHA", "Docosahexaenoic Acid"),
    ("ARA", "Arachidonic Acid"),
    ("IgA", "Imunoglobulin A"),
    ("UHC", "Universal Health Coverage"),
    ("RUTF", "Ready to Use Therapeutic Food"),
    ("NTD", "Neural Tube Defect"),
    ("LAM", "Lactational Amenorrhea Method"),
    ("TFC", "Therapeutic Feeding Center"),
]

# Misspellings and their corrections.
TYPOS = [
    ("stuntig", "stunting"),
    ("stuntiing", "stunting"),
    ("gisi", "gizi"),
    ("nutirisi", "nutrisi"),
    ("kehamlan", "kehamilan"),
    ("posayandu", "posyandu"),
    ("pusekesmas", "puskesmas"),
    ("balits", "balita"),
    ("imunisas", "imunisasi"),
]

# Units that are set apart from the number before them; the last needs no word end.
UNITS = [("mg|mcg|g|kg|IU|kkal|kcal", True), ("cm|mm|m", True), ("ml|liter|L", True), ("%", False)]

# Terms that put a chunk into a category.
DOMAIN_KEYWORDS = {
    "stunting": ["stunting", "pendek", "sangat pendek", "gagal tumbuh"],
    "gizi": ["gizi", "nutrisi", "malnutrisi", "defisiensi", "kekurangan gizi"],
    "asi": ["asi", "menyusui", "laktasi", "kolostrum", "air susu ibu"],
    "mpasi": ["mpasi", "makanan pendamping", "bubur bayi", "finger food"],
    "ibu_hamil": ["ibu hamil", "kehamilan", "hamil", "trimester", "janin"],
    "balita": ["balita", "bayi", "anak", "batita", "toddler"],
    "gizi_buruk": ["gizi buruk", "marasmus", "kwashiorkor", "kurus"],
    "anemia": ["anemia", "hemoglobin", "hb rendah", "kurang darah"],
    "posyandu": ["posyandu", "kader", "penimbangan", "kms"],
    "puskesmas": ["puskesmas", "tenaga kesehatan", "dokter", "bidan", "ahli gizi"],
    "kendari": ["kendari", "sulawesi tenggara", "kota kendari"],
    "dampak": ["dampak", "akibat", "konsekuensi", "kognitif", "kecerdasan", "produktivitas", "penyakit kronis", "jangka panjang"],
    "intervensi_spesifik": ["intervensi spesifik", "suplementasi", "tablet tambah darah", "vitamin", "mineral", "tatalaksana", "terapi gizi"],
    "intervensi_sensitif": ["intervensi sensitif", "sanitasi", "air bersih", "ctps", "ketahanan pangan", "perlindungan sosial", "pkh", "bpnt"],
    "gizi_ibu_hamil": ["gizi ibu hamil", "nutrisi kehamilan", "asam folat", "zat besi", "kalsium", "protein ibu", "suplemen kehamilan"],
}

# Topics and the terms that a query on them is expanded by.
QUERY_SYNONYMS = {
    "stunting": ["pendek", "gagal tumbuh", "kurang gizi kronis", "sangat pendek"],
    "gizi buruk": ["malnutrisi", "kurang gizi", "wasting", "marasmus", "kwashiorkor"],
    "ibu hamil": ["kehamilan", "hamil", "prenatal", "antenatal", "bumil"],
    "bayi": ["neonatus", "newborn", "anak baru lahir", "balita"],
    "asi": ["air susu ibu", "menyusui", "laktasi"],
    "mpasi": ["makanan pendamping", "makanan tambahan bayi"],
    "posyandu": ["pos pelayanan terpadu", "penimbangan", "pemantauan pertumbuhan"],
    "anemia": ["kurang darah", "hb rendah", "hemoglobin rendah"],
    "kek": ["kurang energi kronis", "lila rendah", "underweight ibu"],
    "kendari": ["kota kendari", "sulawesi tenggara", "sultra"],
    "dampak": ["akibat", "konsekuensi", "efek", "pengaruh", "risiko jangka panjang", "perkembangan kognitif", "kecerdasan", "produktivitas"],
    "intervensi spesifik": ["intervensi gizi", "suplementasi", "tablet tambah darah", "vitamin mineral", "gizi langsung", "tatalaksana gizi"],
    "sensitif": ["intervensi sensitif", "program pemerintah", "sanitasi", "air bersih", "ketahanan pangan", "perlindungan sosial", "program keluarga"],
    "kebutuhan gizi": ["gizi ibu hamil", "nutrisi kehamilan", "asupan ibu", "zat besi", "asam folat", "protein ibu", "kalori ibu hamil"],
}

# Words that never count in reranking.
STOPWORDS = [
    "apa", "adalah", "yang", "di", "ke", "dari", "dan", "atau", "untuk", "dengan",
    "pada", "ini", "itu", "dalam", "oleh", "jika", "maka", "serta", "juga", "dapat",
    "harus", "akan", "telah", "sudah", "tidak", "anak", "bayi", "balita", "stunting", "gizi",
]

# Terms of questions that are out of, and in, the scope of the corpus.
OUT_OF_SCOPE = [
    "presiden", "politik", "pemilu", "saham", "kripto", "bitcoin", "film", "musik", "lagu", "artis",
    "sepak bola", "bola basket", "cuaca", "ramalan", "togel", "judi", "resep masakan dewasa", "hukum", "pengacara", "pajak",
    "kode program", "coding", "sejarah dunia", "geografi", "matematika", "fisika", "kimia",
]
IN_SCOPE = [
    "stunting", "gizi", "nutrisi", "bayi", "balita", "anak", "ibu hamil", "asi", "mpasi", "posyandu",
    "puskesmas", "kesehatan", "tumbuh", "berat badan", "tinggi badan", "menyusui", "kehamilan", "kendari", "anemia", "protein",
    "vitamin", "mineral", "kek", "kalori",
]

# Topic buttons and the questions they ask.
TOPICS = [
    ("Definisi Stunting", "Penyebab dan pencegahan", "Apa itu stunting dan bagaimana cara mencegahnya?"),
    ("MPASI", "Panduan makanan pendamping ASI", "Kapan dan bagaimana cara memberikan MPASI yang benar?"),
    ("Gizi Ibu Hamil", "Nutrisi dan suplemen kehamilan", "Apa saja kebutuhan gizi ibu hamil untuk mencegah stunting?"),
    ("ASI dan Menyusui", "Manfaat dan teknik menyusui", "Bagaimana manfaat ASI dan cara menyusui yang benar?"),
    ("Deteksi Dini", "Tanda dan pemantauan tumbuh kembang", "Apa saja tanda stunting pada anak dan cara mendeteksinya?"),
    ("Layanan Kesehatan Kendari", "Posyandu dan puskesmas terdekat", "Di mana layanan posyandu dan puskesmas di Kota Kendari?"),
]
