"""Fixed values of the span masker: words of roles, birth dates and months, as in the reference."""

ROLES = ["registered owner", "vehicle owner", "account holder", "complainant", "petitioner", "respondent", "plaintiff", "defendant", "applicant", "accused", "witness", "patient", "nominee", "owner", "पंजीकृत मालिक", "रजिस्टर्ड मालिक", "वाहन मालिक", "मालिक", "பதிவுசெய்யப்பட்ட உரிமையாளர்", "வாகன உரிமையாளர்", "உரிமையாளர்", "నమోదైన యజమాని", "వాహన యజమాని", "యజమాని", "രജിസ്റ്റർ ചെയ്ത ഉടമ", "വാഹന ഉടമ", "ഉടമ", "ನೋಂದಾಯಿತ ಮಾಲೀಕ", "ವಾಹನ ಮಾಲೀಕ", "ಮಾಲೀಕ", "नोंदणीकृत मालक", "वाहन मालक", "मालक", "নিবন্ধিত মালিক", "যানবাহনের মালিক", "মালিক", "ପଞ୍ଜୀକୃତ ମାଲିକ", "ଯାନ ମାଲିକ", "ମାଲିକ", "शिकायतकर्ता", "याचिकाकर्ता", "खाताधारक", "प्रतिवादी", "अभियुक्त", "नामांकित", "आवेदक", "आरोपी", "गवाह", "मरीज़", "मरीज", "रोगी", "वादी", "குற்றவாளி", "புகார்தாரர்", "எதிர்மனுதாரர்", "விண்ணப்பதாரர்", "கணக்குதாரர்", "மனுதாரர்", "எதிர்வாதி", "நோயாளி", "நாமினி", "சாட்சி", "வாதி", "నిందితుడు", "దరఖాస్తుదారు", "అభియుక్తుడు", "ఫిర్యాది", "ప్రతివాది", "ఖాతాదారు", "పిటిషనర్", "నామినీ", "సాక్షి", "వాది", "రోగి", "ದೂರುದಾರ", "ಖಾತೆದಾರ", "ಪ್ರತಿವಾದಿ", "ಅರ್ಜಿದಾರ", "ಆರೋಪಿ", "ನಾಮಿನಿ", "ಸಾಕ್ಷಿ", "ವಾದಿ", "ರೋಗಿ", "പരാതിക്കാരൻ", "ഹർജിക്കാരൻ", "പ്രതിവാദി", "അപേക്ഷകൻ", "അക്കൗണ്ട് ഉടമ", "സാക്ഷി", "രോഗി", "വാദി", "നോമിനി", "तक्रारदार", "साक्षीदार", "नामनिर्देशित", "खातेदार", "अर्जदार", "रुग्ण", "অভিযোগকারী", "আবেদনকারী", "হিসাবধারী", "বিবাদী", "আসামি", "সাক্ষী", "মনোনীত", "রোগী", "বাদী", "ଅଭିଯୋଗକାରୀ", "ଆବେଦନକାରୀ", "ପ୍ରତିବାଦୀ", "ଖାତାଧାରୀ", "ଅଭିଯୁକ୍ତ", "ମନୋନୀତ", "ସାକ୍ଷୀ", "ରୋଗୀ", "ବାଦୀ"]
PARTICLES = ["का", "की", "के", "को", "में", "है", "हैं", "ने", "से", "पर", "लिए", "और", "या", "இன்", "மற்றும்", "గారి", "ആണ്", "ಆಗಿದೆ", "आहे", "आहेत", "यांना", "यांनी", "এর", "ଙ୍କ"]
ROLE_STOPS = ["the", "court", "city", "notice", "summons", "shall", "should", "must", "this", "that", "you", "your", "and", "for", "with", "from", "case", "suit", "order", "date", "amount", "name", "aged", "age", "hall", "no"]
INSTITUTIONS = ["shield health insurance", "city diagnostics", "green leaf diagnostics", "green leaf clinic", "shanthi family clinic", "social welfare dept", "social welfare department", "sunrise mobiles", "sunrise mobiles & electronics", "anand nagar municipality", "revenue department", "city traffic police", "traffic police", "sunrise hospital", "apollo hospital", "virtual court", "court of the city civil judge", "city civil court", "city civil court complex", "suryodaya mutual fund", "sample bank ltd", "sample bank", "district legal services authority"]
BIRTH_LABELS = r"date\s+of\s+birth|birth\s*date|d\.o\.b\.|dob|born(?:\s+on)?|जन्म\s*तिथि|जन्मतिथि|जन्म\s*की\s*तारीख|जन्म\s*तारीख|जन्म\s*दिनांक|பிறந்த\s*தேதி|பிறந்த\s*நாள்|పుట్టిన\s*తేదీ|పుట్టిన\s*తేది|జన్మ\s*తేదీ|జన్మ\s*తేది|జన్మ\s*దినం|ജനനത്തീയതി|ജനന\s*തീയതി|ജനന\s*തിയതി|ಹುಟ್ಟಿದ\s*ದಿನಾಂಕ|ಜನ್ಮ\s*ದಿನಾಂಕ|ಜನನ\s*ದಿನಾಂಕ|জন্ম\s*তারিখ|জন্ম\s*দিন|ଜନ୍ମ\s*ତାରିଖ|ଜନ୍ମ\s*ତିଥି"
# Names of the months of nine languages by number; English ones by their first three letters.
MONTHS = {
    1: ["जनवरी", "जानेवारी", "ஜனவரி", "జనవరి", "ജനുവരി", "ಜನವರಿ", "জানুয়ারি", "জানুয়ারি", "ଜାନୁଆରୀ"],
    2: ["फ़रवरी", "फरवरी", "फेब्रुवारी", "பிப்ரவரி", "ఫిబ్రవరి", "ഫെബ്രുവരി", "ಫೆಬ್ರವರಿ", "ফেব্রুয়ারি", "ফেব্রুয়ারি", "ଫେବୃଆରୀ"],
    3: ["मार्च", "மார்ச்", "మార్చి", "മാർച്ച്", "ಮಾರ್ಚ್", "মার্চ", "ମାର୍ଚ୍ଚ"],
    4: ["अप्रैल", "एप्रिल", "ஏப்ரல்", "ఏప్రిల్", "ഏപ്രിൽ", "ಏಪ್ರಿಲ್", "এপ্রিল", "ଏପ୍ରିଲ"],
    5: ["मई", "मे", "மே", "మే", "മേയ്", "ಮೇ", "মে", "ମଇ"],
    6: ["जून", "ஜூன்", "జూన్", "ജൂൺ", "ಜೂನ್", "জুন", "ଜୁନ"],
    7: ["जुलाई", "जुलै", "ஜூலை", "జూలై", "ജൂലൈ", "ಜುಲೈ", "জুলাই", "ଜୁଲାଇ"],
    8: ["अगस्त", "ऑगस्ट", "ஆகஸ்ட்", "ఆగస్టు", "ഓഗസ്റ്റ്", "ಆಗಸ್ಟ್", "আগস্ট", "ଅଗଷ୍ଟ"],
    9: ["सितम्बर", "सितंबर", "सप्टेंबर", "செப்டம்பர்", "సెప్టెంబర్", "സെപ്റ്റംബർ", "ಸೆಪ್ಟೆಂಬರ್", "সেপ্টেম্বর", "ସେପ୍ଟେମ୍ବର"],
    10: ["अक्टूबर", "अक्तूबर", "ऑक्टोबर", "அக்டோபர்", "అక్టోబర్", "ഒക്ടോബർ", "ಅಕ್ಟೋಬರ್", "অক্টোবর", "ଅକ୍ଟୋବର"],
    11: ["नवम्बर", "नवंबर", "नोव्हेंबर", "நவம்பர்", "నవంబర్", "നവംബർ", "ನವೆಂಬರ್", "নভেম্বর", "ନଭେମ୍ବର"],
    12: ["दिसम्बर", "दिसंबर", "डिसेंबर", "டிசம்பர்", "డిసెంబర్", "ഡിസംബർ", "ಡಿಸೆಂಬರ್", "ডিসেম্বর", "ଡିସେମ୍ବର"],
}
ENGLISH_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
