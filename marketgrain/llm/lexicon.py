"""Words of grocery listings in two languages.

Fixed values. Each line names a food and how it is written: alternatives are divided by "|"; the words of an alternative
may stand anywhere in the name, in any order. Below a food are its varieties in the same form. The tables are the default of a
parameter; words that no line knows stay as they are and are compared as they stand.
"""

FOODS = """
cat_food: храна котки | cat food
  fish: риба | fish
  chicken: пиле | пилешко | chicken
laundry: прах пране | перилен препарат | laundry powder
  white: бяло | white
  color: цветно | color
soap: течен сапун | liquid soap
  aloe: алое | aloe
  lavender: лавандула | lavender
toilet_paper: тоалетна хартия | toilet paper
  ply2: двупластова | 2 пласта | 2 ply
  ply3: трипластова | 3 пласта | 3 ply
peanut_butter: фъстъчено масло | peanut butter
  smooth: гладко | кремообразно | creamy | smooth
  crunchy: хрупкаво | crunchy
tuna: риба тон | тон | tuna fish | tuna
  brine: собствен сос | собств сос | brine
  olive_oil: зехтин | olive oil
  vegetable_oil: олио | растително масло | раст масло | veg oil | vegetable oil
cream_sauce: крем сос | cream sauce
  mushroom: гъби | mushroom
  pesto: песто | pesto
tomato_puree: доматено пюре | tomato puree | tomato paste
  c22_24: 22 24
  c28_30: 28 30
skyr: протеинов скир | скир | skyr
  plain: натурален | plain | natural
  vanilla: ванилия | vanilla
  strawberry: ягода | ягоди | strawberry
kashkaval: кашкавал | кашк | kashkaval | yellow cheese
  smoked: пушен | smoked
  semi_hard: полутвърд | полутв | semi hard
  cow: краве мляко | краве | cow milk | cow
white_cheese: бяло саламурено сирене | бяло сирене | сирене | white cheese | sirene
  cow: краве мляко | краве | cow milk | cow
  goat: козе мляко | козе | goat milk | goat
  sheep: овче мляко | овче | sheep milk | sheep
curd: извара | izvara | curd
  low_fat: нискомаслена | нискомасл | low fat
  cow: краве мляко | краве | cow milk | cow
yogurt: кисело мляко | к мляко | kiselo mlyako | yogurt
milk: прясно мляко | пр мляко | fresh milk
  lactose_free: безлактозно | без лактоза | lactose free
frozen_vegetables: замразени зеленчуци | frozen vegetables
  spinach: спанак | spinach
  broccoli: броколи | broccoli
  green_beans: зелен боб | зелен фасул | green beans
salmon: пушена сьомга | smoked salmon
  whole: цяло филе | whole side
  sliced: слайс | филирана | sliced
chicken_fillet: пилешко филе | chicken fillet
  chilled: охладено | охл | chilled
  frozen: замразено | зам | frozen
mince: кайма | minced meat | mince
  beef: телешка | телешко | beef
  pork: свинска | свинско | pork
  mixed: смес | mixed
eggs: кокоши яйца | яйца | eggs
  free_range: свободно отглеждане | свободни кокошки | free range
  size_s: клас s | размер s | size s
  size_m: клас m | размер m | size m
  size_l: клас l | размер l | size l
tofu: тофу | tofu
  natural: натурално | natural | plain
  smoked: пушено | smoked
bread: хляб | bread
  white: бяло брашно | бял | white
  rye: ръжен | rye
  wholegrain: пълнозърнест | пълнозърн | wholegrain
flour: брашно | flour
  type500: тип 500 | type 500
  type1850: грахам тип 1850 | тип 1850 | type 1850 | graham type 1850
pasta: макарони | паста | pasta
  spaghetti: спагети | spaghetti
  penne: пене | penne
  fusilli: фузили | fusilli
rice: ориз | rice
  basmati: басмати | basmati
  jasmine: жасмин | jasmine
  brown: кафяв | пълнозърнест | brown | wholegrain
oats: овесени ядки | oat flakes | oats
  fine: фини | fine
  coarse: едри | jumbo | coarse
biscuits: бисквити | biscuits
  vanilla: ванилия | vanilla
  hazelnut: лешник | лешници | hazelnut
lentils: леща | lentils
  red: червена | red
  green: зелена | green
  brown: кафява | brown
coffee: кафе | coffee
  ground: мляно | ground
  beans: зърна | whole beans | beans
beans: боб | фасул | beans
  white: бял | white
  red: червен | red
  pinto: пъстър | шарен | pinto
chickpeas: нахут | chickpeas
  cooked: готов варен | сварен | варен | cooked | boiled
  dry: сурови зърна | сух | dry | dried | raw
almonds: бадеми | almonds
  raw: сурови | raw
  roasted: печени | roasted
walnuts: орехови ядки | орех | walnuts
  light: светли ядки | светъл | светли | light
  pieces: трошени | натрошен | pieces
chocolate: шоколад | chocolate
  milk: млечен | milk
  white: бял | white
  dark: черен | тъмен | dark
pepper: черен пипер | black pepper
  ground: млян | ground
  whole: цели зърна | зърна | whole corns | whole
sunflower_oil: слънчогледово олио | олио | sunflower oil
  refined: рафинирано | refined
  cold_pressed: студено пресовано | cold pressed
olive_oil: зехтин | olive oil
  extra_virgin: екстра върджин студено пресован | екстра върджин | extra virgin cold pressed | extra virgin
  pomace: кюспе | pomace
juice: плодов сок | сок | juice
  orange: портокал | orange
  apple: ябълка | apple
  sour_cherry: вишна | вишни | sour cherry
water: минерална вода | mineral water
  still: негазирана | без газ | still
  sparkling: газирана | газ | sparkling
butter: краве масло | масло | butter
  salted: осолено | salted
  unsalted: безсолно | unsalted
"""

# Words and phrases of advertising, and words without meaning of their own.
ADVERTISING = (
    "само с карта | от тази седмица | за цялото семейство | вкусът на лятото | ограничено количество | нова опаковка | топ избор | хит цена | "
    "супер оферта | омега 3 линия | № 1 на рафта | no 1 | προϊόν ελλάδας | best price | само днес | ексклузивно | българско | по изгодно | акция | ново | промо | "
    "new | crème | délice | offer | sale | промоция | оферта | семейна опаковка | special"
)
FILLERS = "с със от на за в и до без при with of in from for the a and пране ядки масл fat опаковка pack нетно тегло net weight ок approx бр броя брой pcs pc пласта ply"
