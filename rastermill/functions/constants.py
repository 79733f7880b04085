"""Fixed values of the coded format."""

# Radices of the four parts of a partition code, and of the other header fields.
F1, F2, F3, F4 = 4, 5, 5, 5
PARTITION_CODES = F1 * F2 * F3 * F4
LINE_LIMITS = 63
COLOR_CODES = 49
FIRST_PALETTE_CODE = 17

# Levels of a region by size, and the divisors of one level's threshold to the next (of 40).
LEVELS = 7
LEVEL_DIVISORS = (1000, 630, 398, 251, 158)
LEVEL_BASE, LEVEL_STEP = 36, 40

# Angles over half a turn, the fixed-point scale of sines, and sides an image may have.
ANGLES = 512
SCALE = 1 << 18
LEAST_SIDE, LARGEST_SIDE = 9, 2048

# log2(4 * 5 * 5 * 5 * 63 * 49)
HEADER_BITS = 20.5577740523

# Entropy coder: slots of the model, and bits of the state.
SLOTS = 1 << 11
STATE_BITS = 16

# CRC64, reflected polynomial C96C5795D7870F42 as a signed number.
CRC64_POLYNOMIAL = 0xC96C5795D7870F42 - (1 << 64)
# Seeds of the two generators.
XORSHIFT_SEED = 0x23DE605F
LCG_FACTOR, LCG_MODULUS = 16807, (1 << 31) - 1

U32 = (1 << 32) - 1
